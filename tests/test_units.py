"""Cases lifted from the service's unit tests (validators, schemas, providers) plus our own."""

import json
import os
import subprocess
import sys
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedlens import schemas as S
from feedlens.functions import text as X
from feedlens.functions.jsonsalvage import salvage
from feedlens.operators import cost as C
from feedlens.operators import ingest as I
from feedlens.operators import ratelimit as U
from feedlens.operators import repair as RP


def test_validate_input(spark):
    df = spark.createDataFrame([("a", "valid content here"), ("b", "Short"), ("c", "  Test content  "),
                                ("d", "   "), ("e", None), ("f", "  abc     ")], "request_id string, content string")
    got = {r.request_id: r.reject_reason for r in I.validate(df).collect()}
    assert got == {"a": None, "b": "too_short", "c": None, "d": "too_short", "e": "missing_content", "f": None}
    n = {r.request_id: r.content for r in I.normalize(I.accepted(df)).collect()}
    assert n["c"] == "Test content" and n["f"] == "abc"


def test_blank_long_rejected(spark):
    df = spark.createDataFrame([("x", " " * 12)], "request_id string, content string")
    assert I.validate(df).first().reject_reason == "blank"


def test_repair_extract(spark):
    df = spark.createDataFrame([("", [], None, None, None)],
                               "problem_statement string, pain_points array<string>, value_drivers array<string>, "
                               "stakeholders array<string>, confidence_score double")
    df = df.withColumn("desired_outcome", F.lit(None).cast("string"))
    r = RP.repair_extract(df).first()
    assert r.pain_points == [S.TEXT_NOT_SPECIFIED_ITEM] and r.value_drivers == [S.TEXT_NOT_SPECIFIED_ITEM]
    assert r.problem_statement == "Customer problem not clearly specified"
    assert r.desired_outcome == "Desired outcome not specified"
    assert r.confidence_score == 0.5 and r.stakeholders == []


def test_repair_self_check(spark):
    df = spark.createDataFrame([(None, None, None, None, None)],
                               "verifications array<struct<claim:string,supported_by_input:boolean,evidence:string,"
                               "confidence:double>>, overall_accuracy double, hallucination_risk double, "
                               "approved boolean, rejection_reason string")
    r = RP.repair_self_check(df).first()
    assert r.approved is False and r.rejection_reason == "Self-check did not approve extraction"
    assert r.verifications == [] and r.overall_accuracy == 0.5


def _vp(spark, points, headline="Great"):
    return spark.createDataFrame([(headline, "p", "s", "d", "go", None, points)],
                                 "headline string, problem string, solution string, differentiation string, "
                                 "call_to_action string, persona string, key_talking_points array<string>")


def test_repair_value_prop(spark):
    r = RP.repair_value_prop(_vp(spark, ["Point 1"])).first()
    assert r.key_talking_points == ["Point 1", "Additional value point 2", "Additional value point 3"]
    assert r.persona == "executive"
    r = RP.repair_value_prop(_vp(spark, [f"Point {i}" for i in range(1, 7)])).first()
    assert len(r.key_talking_points) == 5
    r = RP.repair_value_prop(_vp(spark, ["a", "b", "c"], headline="")).first()
    assert r.headline == "Headline not specified"
    c = RP.conform_value_prop(RP.repair_value_prop(_vp(spark, ["a", "b", "c"], headline="x" * 201))).first()
    assert not c.valid and c.violations == ["headline_max_length"]


def test_conform_extract_range(spark):
    df = spark.createDataFrame([("p", "o", ["a"], ["b"], 1.5)],
                               "problem_statement string, desired_outcome string, pain_points array<string>, "
                               "value_drivers array<string>, confidence_score double")
    c = RP.conform_extract(df).first()
    assert c.violations == ["confidence_score_range"]


def test_model_config_bounds(spark):
    df = spark.createDataFrame([("openai", 2.5, 100, 30), ("google", 0.7, 2000, 30)],
                               "provider string, temperature double, max_tokens int, timeout_seconds int")
    got = [r.violations for r in RP.conform_config(df).collect()]
    assert got == [["temperature_range"], []]


def test_cost(spark):
    df = spark.createDataFrame([("anthropic", "claude-unknown", 1000, 500), ("openai", "gpt-unknown", 1000, 500),
                                ("google", "gemini-2.5-flash-lite", 1000, 500)],
                               "provider string, model string, tokens_input long, tokens_output long")
    got = [r.cost_usd for r in C.with_cost(df).orderBy("provider").collect()]
    assert got == [0.0105, 0.000113, 0.0075]


def test_json_salvage_shapes(spark):
    rows = [('{"a": 1, "b": 2, "c": 3}', "direct"),
            ('text ```json\n{"a": 1}\n``` more', "fenced"),
            ('```json\n{"a": 1} tail', "open_fence"),
            ('x {"a": 1} y {"a": 1, "b": 2, "c": 3} z', "longest"),
            ('x {"a": 1} y {"b": 2}', "first"),
            ('{"a": 1, "b": [1, 2,],}', "cleaned"),
            ('oops { {"a": 1, "b": 2} end', "regex"),
            ("no json here", "rejected")]
    df = spark.createDataFrame(rows, "content string, expected string")
    got = [(r.strategy, r.expected) for r in salvage(df).collect()]
    assert all(a == b for a, b in got), got


def test_pii(spark):
    df = spark.createDataFrame([("1", "mail a.b@example.com, card 4111 1111 1111 1111, bad 4111 1111 1111 1112, "
                                      "ssn 123-45-6789, call +1 (555) 555-0100")], "request_id string, content string")
    p = I.pii_table(df).collect()
    assert sorted(r.pii_type for r in p) == ["credit_card", "email", "phone", "ssn"]
    text = df.first().content
    for r in p:
        assert text[r.span_start:r.span_end] == r.value
    red = df.select(X.redact(F.col("content")).alias("r")).first().r
    assert "example.com" not in red and "6789" not in red


def test_word_count(spark):
    df = spark.createDataFrame([("",), ("  ",), ("a b c",), (" one ",)], "t string")
    assert [r.n for r in df.select(X.word_count(F.col("t")).alias("n")).collect()] == [0, 0, 3, 1]


def test_rate_limit(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, 1, t0 + timedelta(seconds=i)) for i in range(12)] + [(100, 1, t0 + timedelta(seconds=70))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.admitted for r in U.rate_limit(df).collect()}
    assert [got[i] for i in range(12)] == [True] * 10 + [False, False]
    assert got[100] is True  # requests 0–9 left the window at t=60…69, rejected ones never counted


def test_brace_objects_edges(spark):
    from feedlens.functions.jsonsalvage import brace_objects
    cases = [('a {"x": {"y": 1}} b {"z": 2}', ['{"x": {"y": 1}}', '{"z": 2}']),
             ('} {"a": 1}', ['{"a": 1}']),          # stray closer is ignored (depth clamped at 0)
             ('{"a": "}"}', ['{"a": "}']),           # braces inside strings count, as in the service
             ('{{}', []),
             ('', []),
             ('{}{}', ['{}', '{}'])]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = [r.o for r in df.select(brace_objects(F.col("t")).alias("o")).collect()]
    assert got == [e for _, e in cases]


def test_history_page(spark):
    from feedlens.operators import history as Hs
    runs = spark.createDataFrame([(f"r{i:02d}", float(i % 7)) for i in range(45)], "run_id string, cost_usd double")
    p3 = Hs.history_page(runs, "cost_usd", page=3).collect()
    assert len(p3) == 5 and {r.total for r in p3} == {45} and {r.pages for r in p3} == {3}
    everything = sorted(((-c, i) for i, c in ((r.run_id, r.cost_usd) for r in runs.collect())))
    assert [r.run_id for r in p3] == [i for _, i in everything][40:45]
    p2 = Hs.history_page(runs, "cost_usd", page=2).collect()
    by_key = Hs.history_page(runs, "cost_usd", page=3, after=(p2[-1].cost_usd, p2[-1].run_id)).collect()
    assert [r.run_id for r in by_key] == [r.run_id for r in p3]


def test_cache_lookup_as_of(spark):
    from feedlens.operators import cache as H
    t0 = datetime(2024, 1, 1, 0, 50)
    cache = spark.createDataFrame([("k", '{"run_id": "a"}', t0), ("k", '{"run_id": "b"}', t0 + timedelta(minutes=20))],
                                  "cache_key string, result_json string, written_at timestamp")
    req = spark.createDataFrame([
        ("1", "k", t0 - timedelta(minutes=1)),     # before any write: miss
        ("2", "k", t0 + timedelta(minutes=5)),     # entry a (crosses the hour bucket edge later)
        ("3", "k", t0 + timedelta(minutes=30)),    # latest entry b wins
        ("4", "k", t0 + timedelta(minutes=75)),    # 02:05, next hour bucket: b (01:10) still live
        ("5", "k", t0 + timedelta(minutes=140)),   # 03:10: b expired: miss
        ("6", "z", t0 + timedelta(minutes=5))],    # other key: miss
        "request_id string, cache_key string, requested_at timestamp")
    got = {r.request_id: (r.hit, r.result_json) for r in H.lookup(req, cache).collect()}
    assert got == {"1": (False, None), "2": (True, '{"run_id": "a"}'), "3": (True, '{"run_id": "b"}'),
                   "4": (True, '{"run_id": "b"}'), "5": (False, None), "6": (False, None)}


def test_bound_columns_of_two_frames(spark):
    a = spark.createDataFrame([("one two",)], "content string")
    b = spark.createDataFrame([("three four five mail a@b.example.com",)], "content string")
    assert a.select(X.word_count(a["content"]).alias("n")).first().n == 2
    assert b.select(X.word_count(b["content"]).alias("n")).first().n == 5
    for fn in (X.redact, X.strip_ws, X.detect_pii):
        a.select(fn(a["content"]).alias("x")).collect()
        b.select(fn(b["content"]).alias("x")).collect()
    assert [r.strategy for r in salvage(b).collect()] == ["rejected"]
    assert a.select(F.lit(1).alias("1")).select(X.word_count(F.col("1").cast("string")).alias("n")).first().n == 1


def test_json_object_shapes(spark):
    from feedlens.functions.jsonsalvage import is_json_object
    cases = [('{"a":1}', True), (' {"a":1}\n', True), ('{"a":"}]"}', True), ('{"a":1}] tail', False),
             ('{"a":1}],[{"b":2}', False), ('{"a":1},{"b":2}', False), ('{"a":1},"x"', False), ('[1]', False), ("", False),
             (None, False), ('{"a":1', False), ('{"a":1} x', False), ('{"a":1},"', False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.ok for r in df.select("i", is_json_object(F.col("t")).alias("ok")).collect()}
    assert [bool(got[i]) for i in range(len(cases))] == [e for _, e in cases]


def test_unreadable_answers_are_not_repaired(spark):
    from feedlens.operators import responses as R
    df = spark.createDataFrame([("r", "sorry, no JSON here")], "run_id string, content string")
    p = R.parse(df, "extract")
    c = RP.conform_extract(RP.repair_extract(p.select("run_id", "type_errors", "parsed.*"))).first()
    assert not c.valid and c.violations == ["unparseable_json"]


def test_log_lines_that_cannot_be_read(spark):
    from feedlens.operators import metrics as MT
    lines = [json.dumps({"event": "e", "timestamp": t, "run_id": str(i)}) for i, t in enumerate(
        ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5Z", "2024-01-01T02:00:00.123456+02:00", "yesterday", None])]
    df = spark.createDataFrame([(x,) for x in [*lines, "no json", '{"event": "cut']], "value string")
    log = MT.parse_log(df).cache()
    t0 = datetime(2024, 1, 1)
    assert [r.ts for r in log.filter("run_id is not null").orderBy("run_id").collect()] == [
        t0, t0 + timedelta(seconds=0.5), t0 + timedelta(microseconds=123456), None, None]
    assert MT.unreadable_lines(log).first().asDict() == {"corrupt_lines": 2, "bad_times": 2}


def test_token_counts_that_are_no_integers(spark):
    from feedlens.operators import responses as R
    env = lambda n: json.dumps({"content": "x", "response_metadata": {"usage": {"input_tokens": n, "output_tokens": 1}}})
    df = spark.createDataFrame([("anthropic", env(v), "p") for v in (7, 12.0, "15", "n/a", None, 1e300)],
                               "provider string, envelope string, prompt string")
    got = [(r.tokens_input, r.tokens_unreadable) for r in R.unpack_envelope(df).collect()]
    assert got == [(7, False), (12, False), (15, False), (0, True), (0, True), (0, True)]


def test_answer_by_provider(spark):
    from feedlens.operators import responses as R
    env = json.dumps({"content": "text", "tool_calls": [{"args": {"k": 1}}]})
    bare = json.dumps({"content": "text", "additional_kwargs": {"function_call": {"name": "f"}}})
    df = spark.createDataFrame([("anthropic", env), ("google", env), ("openai", env), ("openai", bare)],
                               "provider string, envelope string")
    assert [r.c for r in df.select(R.envelope_content().alias("c")).collect()] == ["text", "text", '{"k":1}', "{}"]


def test_active_runs_peak_and_dense_periods(spark):
    from feedlens.operators import metrics as MT
    t = lambda m: datetime(2024, 1, 1, 0, m)
    runs = spark.createDataFrame([(t(4), t(6)), (t(4), t(17))], "started_at timestamp, completed_at timestamp")
    got = {r.bucket.minute: r.peak_active for r in MT.active_runs(runs).collect()}
    assert got == {0: 2, 5: 2, 10: 1, 15: 1}
    assert MT.active_runs(runs.filter("false")).count() == 0


def test_exposition_escapes_and_small_numbers(spark):
    from feedlens.operators import metrics as MT
    df = spark.createDataFrame([("m", 'a"b\\c\nd', 1e-7), ("m", "x", 100.0), ("m", "y", 0.0)], "metric string, l string, value double")
    assert [r.line for r in MT.exposition(df, ["l"]).collect()] == [
        'm{l="a\\"b\\\\c\\nd"} 0.0000001', 'm{l="x"} 100', 'm{l="y"} 0']


def test_search_takes_wildcards_literally(spark):
    from feedlens.operators import history as Hs
    df = spark.createDataFrame([("1", "a 100% sure thing"), ("2", "a 100 sure thing"), ("3", "snake_case"), ("4", "snakeXcase")],
                               "request_id string, content string")
    assert [r.request_id for r in Hs.history_search(df, "100%").collect()] == ["1"]
    assert [r.request_id for r in Hs.history_search(df, "SNAKE_").collect()] == ["3"]


def test_exact_percentiles_of_skewed_groups(spark):
    from feedlens.operators import metrics as MT
    rng = np.random.default_rng(4)
    rows = [("big", float(x)) for x in rng.exponential(size=3000)] + [("ties", 1.0)] * 500 + [("one", 2.5), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows + [("big", None)], "g string, v double")
    ps = [0.0, 0.5, 0.95, 0.999, 1.0]
    got = {(r.g, r.p): r.value for r in MT.exact_percentiles(df, ["g"], "v", ps).collect()}
    for g in ("big", "ties", "one", None):
        v = [x for k, x in rows if k == g]
        for p in ps:
            assert got[g, p] == pytest.approx(np.quantile(v, p)), (g, p)


def test_trailing_count_over_bucket_edges(spark):
    rng = np.random.default_rng(5)
    t0 = datetime(2024, 1, 1)
    rows = [(i, int(rng.integers(0, 3)), t0 + timedelta(seconds=int(s))) for i, s in enumerate(rng.integers(0, 9000, 600))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.n_window for r in U.trailing_count(df).collect()}
    for i, u, t in rows:
        assert got[i] == sum(u2 == u and t - timedelta(seconds=60) < t2 <= t for _, u2, t2 in rows)


def test_rate_limit_does_not_depend_on_bucket_size(spark, sf_dir):
    from feedlens.sources.tables import table
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    a, b = (sorted(U.rate_limit(e, bucket_seconds=s).select("event_id", "admitted").collect()) for s in (300, 3600))
    assert a == b


def test_cache_ties_do_not_depend_on_partitioning(spark):
    from feedlens.operators import cache as H
    t0 = datetime(2024, 1, 1)
    rows = [("k", json.dumps({"run_id": str(i)}), t0) for i in range(20)]
    cache = spark.createDataFrame(rows, "cache_key string, result_json string, written_at timestamp")
    req = spark.createDataFrame([("1", "k", t0 + timedelta(minutes=1))], "request_id string, cache_key string, requested_at timestamp")
    seen = {(H.latest_entries(c).first().result_json, H.lookup(req, c).first().result_json)
            for c in (cache.coalesce(1), cache.repartition(7), cache.orderBy(F.desc("result_json")))}
    assert len(seen) == 1 and len(set(seen.pop())) == 1


def test_cache_lookup_splits_agree(spark, sf_dir):
    from feedlens.operators import cache as H
    from feedlens.sources import fixtures as FX
    f = H.with_cache_key(I.fill_defaults(FX.fx_feedback(spark, sf_dir))).select("request_id", "cache_key", "requested_at")
    got = [sorted((r.request_id, r.hit, r.result_json or "") for r in H.lookup(f, FX.fx_cache(spark, sf_dir), splits=n).collect())
           for n in (1, 4, 7)]
    assert got[0] == got[1] == got[2] and any(h for _, h, _ in got[0])


def test_sums_round_to_ten_decimals(spark):
    from feedlens.functions.exact import xsum
    df = spark.createDataFrame([(0.123456789012,), (0.1,)], "x double")
    assert df.agg(xsum("x").alias("s")).first().s == 0.223456789


def test_generate_batch_fills_the_record(spark):
    from feedlens.operators import generate as G

    def echo(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["run_id", "step", "provider", "model"]].assign(content="x" + batch["prompt"])
    df = spark.createDataFrame([("1", "extract", "google", "m", "p")],
                               "run_id string, step string, provider string, model string, prompt string")
    r = G.generate_batch(df, echo).first()
    assert r.content == "xp" and r.error is None and r.tokens_input is None


def test_model_text_is_redacted_again(spark):
    notes = spark.createDataFrame([("1", "call +1 (555) 555-0100 now")], "request_id string, content string")
    answer = json.dumps({"language": " EN ", "pii_detected": True, "redacted_text": "call +1 (555) 555-0100, a@b.example.com"})
    r = I.merge_ingest(notes, spark.createDataFrame([("1", answer)], "request_id string, content string")).first()
    assert r.language == "en" and "555" not in r.cleaned_content and "@" not in r.cleaned_content


def test_null_rejection_reason_is_still_an_error(spark):
    from feedlens.operators import results as W
    null = lambda t: F.lit(None).cast(t)
    base = spark.range(1).select(F.lit("r").alias("run_id"), F.lit(True).alias("valid"), F.array().cast("array<string>").alias("violations"))
    norm = base.select("run_id", *[null(f.dataType).alias(f.name) for f in S.NORMALIZED.fields])
    step = lambda schema, **v: base.select("*", *[F.lit(v[f.name]).alias(f.name) if f.name in v else
                                                  null(f.dataType).alias(f.name) for f in schema.fields])
    r = W.outcome(norm, step(S.EXTRACTED), step(S.SELF_CHECK, approved=False), step(S.VALUE_PROP)).first()
    assert not r.success and r.error.startswith("Self-check failed: ")
    r = W.outcome(norm, step(S.EXTRACTED).filter("false"), step(S.SELF_CHECK), step(S.VALUE_PROP)).first()
    assert (r.success, r.error) == (False, "extract: missing")


def test_compare_without_costs(spark):
    from feedlens.operators import history as Hs
    runs = spark.createDataFrame([(1, "google", True, True, 1.0, 0.5, 0.9), (1, "openai", True, False, 1.0, 0.5, 0.8)],
                                 "input_key long, provider string, success boolean, from_cache boolean, duration_s double, "
                                 "cost_usd double, accuracy double")
    assert Hs.compare_winner(runs).first().provider == "openai"
    assert {r.pct_over_cheapest for r in Hs.compare_cost_diff(runs).collect()} == {None}


@pytest.mark.parametrize("folder", [None, "file"])
def test_queries_run_without_and_with_a_checkpoint_folder(tmp_path, sf_dir, folder):
    """A fresh process without Spark defaults: the folder is unset, or given as file: URL."""
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
b = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
if {folder!r}:
    b = b.config("spark.checkpoint.dir", "file://{tmp_path}/shared")
spark = b.getOrCreate()
import __spark_entry__ as E
assert E.entry(spark).count() == 3
for name in ("latency_pct", "rate_limit", "stream_windows"):
    assert E.queries()[name](spark, {sf_dir!r}).count() > 0
print("fine")
"""
    conf = tmp_path / "conf"
    conf.mkdir()
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=tmp_path,
                         env={**os.environ, "SPARK_CONF_DIR": str(conf)})
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]


def test_refused_values_count_nowhere(spark):
    from feedlens.functions import exact as X_
    df = spark.createDataFrame([(1.5,), (2.5,), (float("nan"),), (1e19,), (float("inf"),), (None,)], "v double")
    r = df.agg(X_.xsum("v").alias("s"), X_.xavg("v").alias("a"), X_.refused("v").alias("n")).first()
    assert (r.s, r.a, r.n) == (4.0, 2.0, 3)


def test_active_runs_with_far_and_missing_times(spark):
    from feedlens.operators import metrics as MT_
    t = datetime(2024, 1, 1)
    rows = [(t, t + timedelta(minutes=12)), (t + timedelta(minutes=1), None), (None, None),
            (datetime(9999, 12, 30), datetime(9999, 12, 30, 0, 1))]
    df = spark.createDataFrame(rows, "started_at timestamp, completed_at timestamp")
    got = [(r.bucket, r.peak_active) for r in MT_.active_runs(df).orderBy("bucket").collect()]
    assert got == [(t, 2), (t + timedelta(minutes=5), 2), (t + timedelta(minutes=10), 2), (datetime(9999, 12, 30), 2)]
    assert MT_.active_runs(df.filter("false")).collect() == []
    now = MT_.active_now(df.filter("started_at < timestamp'2025-01-01'")).first().value
    assert now == 2


def test_sliding_rate_equals_one_copy_a_window(spark):
    from feedlens.operators import metrics as MT_
    df = spark.range(500).select(F.timestamp_micros(F.col("id") * 7_777_777).alias("ts"))
    w = F.window("ts", "5 minutes", "1 minute")
    want = df.groupBy(w.start.alias("a")).agg(F.count(F.lit(1)).alias("n")).collect()
    got = MT_.sliding_rate(df).collect()
    assert {(r.window_start, r.n) for r in got} == {(r.a, r.n) for r in want}
    assert all(r.window_end - r.window_start == timedelta(minutes=5) for r in got)


def test_retry_failed_counts_missing_keys_as_a_key(spark):
    from feedlens.operators import history as Hs_
    t = datetime(2024, 1, 1)
    rows = [("a", 1, None, False, t), ("b", 1, None, True, t + timedelta(hours=1)), ("c", 1, "x", False, t), ("d", None, None, False, t)]
    df = spark.createDataFrame(rows, "run_id string, user_id long, source string, success boolean, started_at timestamp")
    assert sorted(r.run_id for r in Hs_.retry_failed(df).collect()) == ["c", "d"]



def test_registry_takes_the_gauge_from_the_peaks_of_all_periods(spark):
    from feedlens.operators import metrics as MT_
    t, minute = datetime(2024, 1, 1), timedelta(minutes=1)
    times = [(t, t + 12 * minute), (t, t + 10.5 * minute), (t + 11 * minute, t + 20 * minute)]
    rows = [(a, b, "google", "m", False, True, False, 1.0, 0.01, 0.1, 5, 6) for a, b in times]
    runs = spark.createDataFrame(rows, "started_at timestamp, completed_at timestamp, provider string, model string, "
                                 "raised boolean, success boolean, from_cache boolean, duration_s double, cost_usd double, "
                                 "risk double, tokens_input long, tokens_output long")
    steps = spark.createDataFrame([], "step string, provider string, status string, started_at timestamp, completed_at timestamp")
    checks = spark.createDataFrame([], "approved boolean, rejection_reason string")
    lines = MT_.registry(runs, steps, checks).filter("family = 'active_workflows' and pos = 2").collect()
    assert [float(r.line.split()[-1]) for r in lines] == [1.0]  # the last period is entered with one run; two run when the last starts
