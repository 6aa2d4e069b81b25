"""Sources and sinks against real files in the shared checkpoint folder."""

import uuid

from pyspark.sql import functions as F

from feedlens import schemas as S
from feedlens.operators import cache as H
from feedlens.operators import ingest as I
from feedlens.operators import metrics as MT
from feedlens.operators import prompts as P
from feedlens.session import checkpoint_dir
from feedlens.sources import fixtures as FX


def _dir(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def test_read_feedback_json(spark, sf_dir):
    f = FX.fx_feedback(spark, sf_dir).select("request_id", "content", "source", "customer_id")
    path = _dir(spark, "feedback")
    f.write.json(path)
    back = I.read_feedback(spark, path, "json")
    assert back.count() == f.count()
    row = back.filter(F.col("source").isNull()).count()
    assert row == 0 and back.filter(F.col("provider") != S.DEFAULT_PROVIDER).count() == 0
    assert sorted(r.request_id for r in back.select("request_id").collect()) == \
        sorted(r.request_id for r in f.select("request_id").collect())


def test_read_log_files_equals_parsed_lines(spark, sf_dir):
    lines = FX.fx_log(spark, sf_dir)
    path = _dir(spark, "log")
    lines.write.text(path)
    from_files = MT.read_log(spark, path).filter(F.col("event") == S.EV_FAILED)
    parsed = MT.parse_log(lines).filter(F.col("event") == S.EV_FAILED)
    cols = ["run_id", "ts", "error"]
    assert sorted(from_files.select(*cols).collect()) == sorted(parsed.select(*cols).collect())


def test_cache_write_and_read_back(spark, sf_dir):
    entries = FX.fx_cache(spark, sf_dir)
    path = _dir(spark, "cache")
    H.write(entries, path)
    back = H.read_results(spark.read.parquet(path))
    assert back.count() == entries.count()
    assert back.filter(F.col("result.success").isNull()).count() == 0
    assert "write_day" in back.columns


def test_prompt_and_metrics_sinks(spark, sf_dir):
    f = FX.fx_feedback(spark, sf_dir).select(F.col("request_id").alias("run_id"), "content", "source")
    pr = f.select("run_id", F.lit("ingest").alias("step"), F.lit("google").alias("provider"),
                  F.lit(S.DEFAULT_MODEL).alias("model"), P.ingest_prompt(F.col("content"), F.col("source")).alias("prompt"))
    path = _dir(spark, "prompts")
    P.write_prompts(P.with_system(pr), path)
    back = spark.read.parquet(path)
    assert back.count() == f.count() and set(back.columns) >= {"system_prompt", "json_schema", "step"}
    lines = MT.exposition(MT.executions(FX.fx_runs(spark, sf_dir)).withColumn("metric", F.lit("x")),
                          ["provider", "model", "status"])
    tpath = _dir(spark, "metrics")
    MT.write_text(lines, tpath)
    assert spark.read.text(tpath).count() == lines.count()


def test_exports_in_each_format(spark, sf_dir):
    from feedlens.operators import results as W
    from feedlens.plans.q_results import _outcome
    res = _outcome(spark, sf_dir).cache()
    for fmt in ("parquet", "json", "csv"):
        path = _dir(spark, f"export-{fmt}")
        W.export(res, path, fmt, partition_by=("success",))
        back = spark.read.options(header="true", multiLine=str(fmt == "csv"), escape='"').format(fmt).load(path)
        assert back.filter("success = 'true'").count() == res.filter("success").count() > 0
        if fmt == "csv":
            assert "value_proposition__headline" in back.columns
