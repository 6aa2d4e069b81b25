"""Mixing and sharding against plain Python, and their edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from feedlens.llm import mixing, sharding
from feedlens.sources.tables import table


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, epochs=3):
    """Share by weight, cap, share the excess anew until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
        open_ -= over
    return target


def brute_mix(rows):
    by = defaultdict(list)
    for doc_id, text, source in rows:
        key = int(hashlib.md5(f"mix:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:15], 16)
        by[source].append((key, -1 if doc_id is None else doc_id, size_of(text), doc_id))
    sizes = {s: sum(r[2] for r in v) for s, v in by.items()}
    target = brute_targets(sizes)
    out = []
    for s, v in by.items():
        budget = int(target[s] + 0.5)
        whole = budget // sizes[s] if sizes[s] else 0
        rest = budget - whole * sizes[s]
        for _, _, n, doc_id in sorted(v):
            part = min(n, max(0, rest))
            rest -= part
            out.append((doc_id, n, sizes[s], round(target[s], 6), whole * n + part))
    return sorted(out, key=repr)


def spark_mix(docs):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])
                   for r in mixing.mix_rows(docs).collect()), key=repr)


def test_mix_matches_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    assert spark_mix(docs) == brute_mix(rows)


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.select("doc_id", "text", "source").collect()]
    assert spark_mix(odd_docs) == brute_mix(rows)
    assert spark_mix(no_docs) == []
    blank = odd_docs.filter("text is null")
    assert {r[3:] for r in spark_mix(blank)} == {(0.0, 0)}


def test_caps_reach_three_epochs(spark):
    docs = spark.createDataFrame([(1, "a", "s1"), (2, "a " * 500, "s2"), (3, "a a", "s3")],
                                 "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in mixing.mix_rows(docs).collect()}
    assert got[1] == (1, 3.0, 3) and got[3] == (2, 6.0, 6)
    assert got[2] == (500, 494.0, 494)


def test_mixed_rows_follow_the_plan(odd_docs):
    taken = {}
    for r in mixing.mix_rows(odd_docs).collect():
        if r["size"]:
            taken.setdefault(r["doc_id"], []).append(-(-r["taken"] // r["size"]))
    got = mixing.mixed(odd_docs)
    assert got.columns == odd_docs.columns
    rows = got.collect()
    assert all(r["size"] == "own size" and r["_g"] == "own _g" for r in rows)
    for doc_id, times in taken.items():
        n = sum(r["doc_id"] == doc_id and r["text"] not in (None, "", " \t\n") for r in rows)
        assert max(times) * len(times) >= n >= sum(times)  # identical rows at a cut stay together


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards_match_brute_force(spark, sf_dir, shards):
    docs = table(spark, sf_dir, "documents")
    rows = sorted((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())
    total, before, want, slots = sum(r[1] for r in rows), 0, [], defaultdict(int)
    for doc_id, n, crc in rows:
        shard = (2 * before + n) * shards // (2 * total)
        want.append((doc_id, n, crc, shard, slots[shard]))
        slots[shard] += 1
        before += n
    got = sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])
                 for r in sharding.shard_rows(docs, shards).collect())
    assert got == want
    assigned = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, shards).collect()}
    assert assigned == {w[0]: w[3] for w in want}


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_rows(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["size"] == 1 and r["text_crc32"] is None for r in rows if r["doc_id"] == 2)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    out = sharding.assign(odd_docs, 4)
    assert set(out.columns) == set(odd_docs.columns) and out.count() == odd_docs.count()
    assert out.filter("shard is null").count() == 0 and out.filter("_g = 'own _g'").count() == out.count()
    assert sharding.shard_rows(no_docs, 4).count() == 0 and sharding.assign(no_docs, 4).count() == 0
