"""The pipeline against plain Python, stage by stage, and its edge cases."""

from collections import Counter

import pytest

import __spark_entry__ as E
import corpus_pipeline as cp
from feedlens.llm import toxicity
from feedlens.sources.tables import table

from .test_decontamination import brute_matches
from .test_expressions import brute_features
from .test_mixing_sharding import brute_mix, size_of
from .test_simhash import expect


def brute_pipeline(spark, sf_dir):
    """(doc_id, shard, times) of what the pipeline keeps."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    known = {r["key"]: (r["pair"], r["ratio"]) for r in model.leaning.collect()}
    rows = []
    for r in docs.collect():
        if model.probability(brute_features(r.text, model, known)[None])[0] < 0.3:
            rows.append((r.doc_id, r.text, r.source))
    heads = {d for d, _, c in expect([(d, t) for d, t, _ in rows]) if d == c}
    rows = [r for r in rows if r[0] in heads]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    leaks = {d for d, _ in brute_matches([(d, t) for d, t, _ in rows], items)}
    rows = [r for r in rows if r[0] not in leaks]
    taken = {d: -(-t // n) for d, n, _, _, t in brute_mix(rows) if n}
    mixed = sorted((d, len(t.encode()) + 1) for d, t, _ in rows for _ in range(taken.get(d, 0)))
    total, before, shards = sum(n for _, n in mixed), 0, {}
    for d, n in mixed:
        shards[d] = max(shards.get(d, 0), (2 * before + n) * cp.SHARDS // (2 * total))
        before += n
    return shards, Counter(d for d, _ in mixed)


def test_stages_as_contracted():
    assert [name for name, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    assert cp.ORACLE_SQL is None and E.queries()["pipeline"] is cp.run


def test_run_matches_brute_force(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    assert got.columns == [*docs.columns, "size", "shard"]
    rows = got.collect()
    shards, times = brute_pipeline(spark, sf_dir)
    assert Counter(r.doc_id for r in rows) == times
    seen = {r.doc_id: r["shard"] for r in rows}
    # copies of one document stay together: at a cut they may go to the shard of their first or last copy
    assert all(abs(seen[d] - s) <= 1 for d, s in shards.items())
    assert sum(seen[d] != s for d, s in shards.items()) <= cp.SHARDS
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == text[r.doc_id] and size_of(r.text) for r in rows)


@pytest.mark.parametrize("name, stage", cp.STAGES, ids=[n for n, _ in cp.STAGES])
def test_each_stage_takes_odd_and_no_rows(spark, sf_dir, odd_docs, no_docs, name, stage):
    for docs in (odd_docs, no_docs):
        out = stage(spark, docs, sf_dir)
        extra = {"size", "shard"} if name == "sharding" else set()
        assert set(out.columns) == set(docs.columns) | extra
        n = len(out.collect())
        assert n == 0 if docs is no_docs else n > 0


def test_every_corpus_query_runs(spark, sf_dir):
    names = {n for n in E.queries() if n.startswith("op")}
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    columns = {"op2": {"doc_id", "size", "source_size", "target", "taken"}, "op3": {"doc_id", "fingerprint", "component_id"},
               "op4": {"doc_id", "held_out", "lang_pred", "score"}, "op5": {"page_id", "host", "path", "rule", "verdict"},
               "op6": {"doc_id", "held_out", "score", "predicted"}, "op8": {"doc_id", "held_out", "score", "predicted"},
               "op7": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op9": {"doc_id", "item_id"},
               "op10": {"query_id", "rank", "vec_id", "score"}, "op1": {"doc_id", "licence"},
               "op11": {"doc_id", "n_shingles", "component_id"}, "op13": {"word", "form", "root", "n", "n_near", "form_n"},
               "op12": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}}
    for n in names:
        df = E.queries()[n](spark, sf_dir)
        assert columns[n.split("_")[0]] <= set(df.columns)
        assert df.count() > 0
