"""Indexed search gives the scan's rows and compares few of them."""
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlens.operators import history as Hs
from feedlens.operators import search as Q


def _edit(rng, t):
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(t) + 1)
        t = rng.choice([t[:k] + rng.choice("0123x") + t[k:], t[:k] + t[k + 1:], t[:k] + rng.choice("0123x") + t[k + 1:]])
    return t


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    words = ["slow", "Billing", "größe", "100%", "a_b", "(x)", "late", "THE", "日本語"]
    data = [(i, " ".join(rng.choices(words, k=rng.randrange(8))) if i % 50 else None,
             _edit(rng, "cust-1234") if i % 3 else ("C" * 60 + str(i) if i % 9 == 0 else None)) for i in range(900)]
    return spark.createDataFrame(data, "request_id long, content string, customer_id string")


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("index")
    Q.write(Q.content_index(rows, "request_id"), f"{at}/contents")
    Q.write(Q.id_index(rows), f"{at}/ids")
    return spark.read.parquet(f"{at}/contents"), spark.read.parquet(f"{at}/ids")


@pytest.mark.parametrize("q, customer", [("billing", None), ("slow THE", "cust-1234"), ("w", "CUST-124"), ("本語 日", "x"),
                                         ("100% a_b", ""), ("nowhere", "C" * 60 + "9"), ("Größe (x)", None), ("", None)])
def test_same_rows_as_the_scan(rows, stored, q, customer):
    want = sorted(r.request_id for r in Hs.history_search(rows, q, customer).collect())
    got = sorted(r.request_id for r in Q.search(rows, *stored, "request_id", q, customer).collect())
    assert got == want


def test_few_rows_are_compared(rows, stored):
    assert Q.content_candidates(stored[0], "request_id", "slow the") .count() < 0.3 * rows.count()
    near = Q.id_candidates(stored[1], "cust-1234").filter(F.length("id") <= Q.LONGEST).count()
    within = stored[1].select("id").distinct().filter(F.levenshtein("id", F.lit("cust-1234")) <= 2).count()
    assert within <= near <= stored[1].select("id").distinct().count()
    plan = Q.id_candidates(stored[1], "cust-1234")._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan and "levenshtein" not in plan


def _pairs(lists):
    return sorted(((gram, key) for gram, keys in lists for key in keys), key=str)


def test_grams_are_stored_with_lists_of_keys(spark):
    texts = [None, "", "ab", "abc", "ABCabc", "aß\U0001f600b\U0001f600", "\ufeffab", "\x00\x00\x00\x00"] + ["the same words again"] * 500
    data = [(None if k % 9 == 4 else f"r{k % 300}", t) for k, t in enumerate(texts)]
    index = Q.content_index(spark.createDataFrame(data, "request_id string, content string").coalesce(2), "request_id").collect()
    want = [(g, key) for key, t in data for g in Q.trigrams((t or "").lower())]
    assert _pairs((r.gram, r["keys"]) for r in index) == sorted(want, key=str)
    assert len(index) <= 2 * len({g for g, _ in want})  # a row for each gram of a task, not for each pair


def test_lists_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(Q, "GATHERED", 10)
    texts = ["abcdef", "", "bcdefgh", "ab", "xyz", "abcdefghijklmnopqr"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3)), pa.array(texts[k:k + 3])], names=["k", "t"]) for k in (0, 3)]
    parts = [dict(zip(*(b.column(j).to_pylist() for j in (0, 1)))) for b in Q._gather(iter(batches))]
    want = sorted(((g, k) for k, t in enumerate(texts) for g in Q.trigrams(t)), key=str)
    assert _pairs(x for part in parts for x in part.items()) == want and len(parts) == 2


def test_shortened_forms():
    assert Q.shortened("ab") == {"ab", "a", "b", ""}
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("ab1") for _ in range(rng.randrange(8)))
        b = "".join(rng.choice("ab1") for _ in range(rng.randrange(8)))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d = _row(d, i, x, b)
        assert d[-1] > 2 or Q.shortened(a) & Q.shortened(b)


def _row(above, i, x, b):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row
