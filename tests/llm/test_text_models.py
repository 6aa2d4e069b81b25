"""Toxicity, language and quality: smoothing against dictionaries, held-out accuracy, edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import langid, quality, toxicity
from feedlens.llm.common import fold
from feedlens.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def test_fold_is_crc32(spark):
    df = spark.createDataFrame([(7,), (123456,), (None,)], "doc_id long")
    got = [r[0] for r in df.select(fold(F.col("doc_id"), 4)).collect()]
    assert got == [zlib.crc32(s.encode()) % 4 for s in ("7", "123456", "")]


def brute_ratio(counts, n, shared, d):
    """log p_toxic - log p_ordinary of a symbol tuple, by recursion over dictionaries."""
    def chain(count):
        levels = {n: count}
        for k in range(n - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        return levels
    pooled = chain(counts[0] + counts[1])
    own = [chain(c) for c in counts]

    def p(k, g):
        t = (pooled if len(g) <= shared else own[k])[len(g)]
        if len(g) == 1:
            return 0.99 * t[g] / sum(t.values()) + 0.01 / 32
        same = [t[h] for h in t if h[:-1] == g[:-1]]
        if not same:
            return p(k, g[1:])
        return (max(t[g] - d, 0) + d * len(same) * p(k, g[1:])) / sum(same)
    return lambda g: math.log(p(1, g)) - math.log(p(0, g))


def test_kneser_ney_against_dictionaries():
    texts = {0: ["the cat sat on the mat", "a hat and the cat"], 1: ["the bad bat sat", "bad cat!"]}
    count = [Counter(int(g) for t in texts[k] for g in toxicity.grams(toxicity.symbols(t))) for k in (0, 1)]
    as_tuple = lambda g: tuple((g >> 5 * k) & 31 for k in range(toxicity.ORDER - 1, -1, -1))
    want = brute_ratio([Counter({as_tuple(g): n for g, n in c.items()}) for c in count], toxicity.ORDER,
                       toxicity.SHARED, toxicity.DISCOUNT)
    dense = np.zeros((2, 1 << 5 * toxicity.ORDER))
    for k in (0, 1):
        dense[k, list(count[k])] = list(count[k].values())
    ratio = toxicity.ratios(*dense)
    unseen = toxicity.grams(toxicity.symbols("the dog sang a bath")).tolist()
    for g in [*count[0], *count[1], *unseen]:
        assert ratio[g] == pytest.approx(want(as_tuple(g)), abs=1e-4)


def test_gram_counts_cover_all_labelled_rows(docs, labels):
    counted = toxicity.counts(docs, labels).filter(F.col("kind") == toxicity.BY_CHARACTER)
    got = {r["key"]: (r["ordinary"], r["toxic"]) for r in counted.collect()}
    want = defaultdict(lambda: [0, 0])
    for r in docs.join(labels, "doc_id").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 in toxicity.FIT:
            for g in toxicity.grams(toxicity.symbols(r["text"])).tolist():
                want[g][r["toxic"]] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_toxicity_finds_held_out_rows(docs, labels):
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert sum(clean) / len(clean) < 0.05
    both = sorted(held, key=lambda r: r["score"])
    top = both[-sum(r["toxic"] for r in held) // 2:]
    assert sum(r["toxic"] for r in top) / len(top) > 0.8


def test_toxicity_of_a_planted_expression(spark):
    """Rare made-up words of two stems are toxic: unseen endings are caught, clean texts left alone."""
    rng = random.Random(1)
    plain = "the old man of this town went home and slept under a tree near its mill with two dogs".split()
    ends = ["a", "or", "ente", "il", "ust", "am", "ock", "eed"]

    def text(toxic, some):
        w = rng.choices(plain, k=30)
        for stem in ("xqzor", "grobex") if toxic else ():
            w[rng.randrange(len(w))] = stem + rng.choice(some)
        return " ".join(w)
    rows = [(k, text(k % 3 == 0, ends[:6])) for k in range(600)]
    new = [(9000 + k, text(k % 2, ends[6:])) for k in range(40)]
    docs = spark.createDataFrame(rows + new, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    assert sum(got[k] != int(k % 3 == 0) for k in range(600)) <= 6
    assert sum(got[9000 + k] != k % 2 for k in range(40)) <= 2


def test_toxicity_edge_cases(spark, odd_docs, no_docs, docs, labels, no_labels):
    assert {r["score"] for r in toxicity.toxicity(odd_docs, no_labels).collect()} == {0.0}
    assert toxicity.without_toxic(odd_docs, no_labels).count() == odd_docs.count()
    model = toxicity.fit(docs, labels)
    rows = toxicity.with_score(odd_docs, model, ["doc_id", "score"]).toDF("doc_id", "own", "score").collect()
    assert {r["own"] for r in rows} == {"own score"}
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    twice = labels.withColumn("toxic", F.lit(None).cast("int")).unionByName(labels).unionByName(labels.select("doc_id", "quality", "toxic"))
    a = toxicity.toxicity(docs, twice).agg(F.sum("score")).first()[0]
    assert a == pytest.approx(toxicity.toxicity(docs, labels).agg(F.sum("score")).first()[0])


def test_language_of_held_out_rows(docs):
    rows = langid.language(docs).join(docs, "doc_id").filter("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert right / len(rows) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(odd_docs, no_docs, docs):
    model = langid.fit(docs)
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(odd_docs, model).collect()}
    for key in ((2, None), (3, ""), (4, " \t\n"), (None, None)):
        assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
    assert model.predict("12 + 3 = 15!") == ("und", 0.0, True)
    assert got[8, "only"]["lang_pred"] in model.pieces and got[8, "only"]["_row"] == "own _row"
    assert {r["lang_pred"] for r in langid.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language(no_docs).count() == 0


def test_language_uses_the_whole_text(docs):
    model = langid.fit(docs)
    texts = {r["lang"]: r["text"] for r in docs.filter("length(text) between 3000 and 6000").dropDuplicates(["lang"]).collect()}
    assert model.predict(texts["en"] + "\n" + texts["de"] * 4)[0] == "de"
    assert model.predict(texts["de"] + "\n" + texts["en"] * 4)[0] == "en"


def test_language_ties_go_to_the_first():
    model = langid.Model({"b": b"same words", "a": b"same words"})
    assert model.predict("same words") == ("a", 0.5, True)


def test_quality_of_held_out_rows(docs, labels):
    rows = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    for q in (0, 1):
        some = [r for r in rows if r["quality"] == q]
        assert sum(r["predicted"] == q for r in some) / len(some) > 0.9


def test_class_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(3)
    p = rng.normal(2, 1, (2000, 3))
    u = np.concatenate([rng.normal(2, 1, (1200, 3)), rng.normal(-2, 1, (800, 3))])
    u = u[rng.permutation(len(u))]
    prior = quality.class_prior(p, u)
    assert 0.5 < prior < 0.72
    net = quality.train(p, u, prior)
    assert (net.score(rng.normal(2, 1, (500, 3))) >= 0.5).mean() > 0.95
    assert (net.score(rng.normal(-2, 1, (500, 3))) < 0.5).mean() > 0.95


def test_quality_edge_cases(odd_docs, no_docs, docs, labels, no_labels):
    assert {r["score"] for r in quality.quality(odd_docs, no_labels).collect()} == {0.5}
    net = quality.fit(docs, labels)
    rows = quality.with_score(odd_docs, net).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(no_docs, labels).count() == 0


def test_samples_are_bounded_in_rows(spark, monkeypatch):
    """A third of all rows under one id: what the driver collects stays within the stated bounds, and still learns."""
    from feedlens.llm import quality, toxicity
    monkeypatch.setattr(quality, "SAMPLE", 40)
    monkeypatch.setattr(toxicity, "TUNE_ROWS", 30)
    seen = []
    monkeypatch.setattr(quality, "learn", lambda p, u: seen.append((len(p), len(u))))
    rows = [(k, f"text {k} of some words {k % 7}") for k in range(600)] + [(4, f"other {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels.unionByName(labels))
    assert seen == [(40, 40)]
    tuned = []
    monkeypatch.setattr(toxicity, "_curve", lambda x, y: tuned.append(len(y)) or toxicity.PLAIN)
    toxicity.fit(docs, labels.unionByName(labels))
    assert tuned and tuned[0] <= 30
