"""Deleting by files and stored quantile sketches."""
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.operators import deletion as D
from feedlens.operators import sketches as K


def _table(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.range(300).select(F.concat(F.lit("r"), F.col("id")).alias("run_id"), (F.col("id") % 6).cast("int").alias("day"),
                                 F.col("id").alias("n"))
    df.repartition(3).write.partitionBy("day").parquet(path)
    return path


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def _ids(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "run_id string")


def test_only_partitions_with_the_ids_are_written(spark, tmp_path):
    path = _table(spark, tmp_path)
    before = _files(path)
    gone = ["r1", "r7", "r3", "unknown"]
    assert D.delete(spark, path, _ids(spark, gone), "day") == 2
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == sorted(set(range(300)) - {1, 7, 3})
    after = _files(path)
    for day in range(6):
        mine = {f for f in before if f"day={day}/" in f}
        assert (mine <= after) == (day not in (1, 3))
    assert D.delete(spark, path, _ids(spark, ["unknown"]), "day") == 0 and _files(path) == after
    assert not os.path.exists(path + ".rewrite")


def test_a_partition_without_rows_goes(spark, tmp_path):
    path = _table(spark, tmp_path)
    assert D.delete(spark, path, _ids(spark, [f"r{k}" for k in range(2, 300, 6)]), "day") == 1
    assert sorted({r.day for r in spark.read.parquet(path).collect()}) == [0, 1, 3, 4, 5]


@pytest.mark.parametrize("step", ["written", "half"])
def test_a_crash_between_the_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = _table(spark, tmp_path)
    real = D.recover

    def crash(s, p, by):
        if os.path.exists(p + ".rewrite"):
            if step == "half":  # the partitions were emptied before the job died
                for f in _files(p):
                    if "day=1/" in f:
                        os.remove(f)
            raise RuntimeError("driver lost")
        return real(s, p, by)
    monkeypatch.setattr(D, "recover", crash)
    with pytest.raises(RuntimeError):
        D.delete(spark, path, _ids(spark, ["r1", "r8"]), "day")
    monkeypatch.setattr(D, "recover", real)
    assert D.recover(spark, path, "day")
    spark.catalog.refreshByPath(path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == sorted(set(range(300)) - {1, 8})
    assert not D.recover(spark, path, "day")


T0 = datetime(2024, 1, 1)


def test_merged_windows_keep_the_rank_bound(spark):
    """1,000 windows merged: each percentile's rank within the stated share of the rows."""
    draws = np.random.default_rng(1).lognormal(size=60_000)
    df = spark.createDataFrame([(T0 + timedelta(seconds=5 * i), i % 2, float(v)) for i, v in enumerate(draws)],
                               "ts timestamp, g int, v double")
    s = K.sketch(df, "v", ["g"])
    assert s.select("window_start").distinct().count() == 1000
    values = {}
    for r in df.collect():
        values.setdefault(r.g, []).append(r.v)
    for r in K.percentiles(s, ["g"], [0.01, 0.5, 0.95, 0.99]).collect():
        rank = np.mean(np.array(values[r.g]) <= r.value)
        assert abs(rank - r.p) <= K.RANK_ERROR and r.n == 30_000


def test_late_windows_replace_their_sketch(spark, tmp_path):
    path = str(tmp_path / "sketches")
    rows = [(T0 + timedelta(minutes=m), "a", float(m)) for m in range(20)]
    df = lambda x: spark.createDataFrame(x, "ts timestamp, g string, v double")
    K.write(K.sketch(df(rows[:8] + rows[10:]), "v", ["g"], version=1), path)
    late = [r for r in rows if rows[5][0] <= r[0] < rows[10][0]]  # the second window, with the rows that came late
    K.write(K.sketch(df(late), "v", ["g"], version=2), path)
    got = K.percentiles(K.current(spark.read.parquet(path), ["g"]), ["g"], [0.0, 0.5, 1.0]).collect()
    assert {(r.p, r.value) for r in got} == {(0.0, 0.0), (0.5, 9.0), (1.0, 19.0)} and got[0].n == 20
    part = K.percentiles(K.current(spark.read.parquet(path), ["g"]), ["g"], [1.0], since=T0, until=T0 + timedelta(minutes=10))
    assert [(r.value, r.n) for r in part.collect()] == [(9.0, 10)]
    assert K.percentiles(K.sketch(df([]), "v", ["g"]), ["g"], [0.5]).collect() == []
