"""Leaning expressions against dictionaries; scores of whole documents; scripts other than Latin."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import expressions, toxicity
from feedlens.sources.tables import table

SF = "/root/testdata/sf0.01"


def brute_expressions(text):
    w = expressions.words(text)
    return {(None, x) for x in w} | {(a, b) for a, b in zip(w, w[1:]) if re.match(f"[{expressions.UNSPACED}]{{2}}$", a + b)}


def key_of(before, word):
    key, _, _ = expressions.expressions(word if before is None else before + word)
    return int(key[-1])


def brute_leaning(texts):
    """{(before, word): ratio} from (text, toxic) rows, by dictionaries."""
    n = [Counter(e for t, k in texts if k == c for e in brute_expressions(t)) for c in (0, 1)]
    every = set(n[0]) | set(n[1])
    alone = {e for e in every if e[0] is None}
    d = expressions.DISCOUNT
    total = [sum(n[c][e] for e in alone) for c in (0, 1)]
    cut = [sum(min(n[c][e], d) for e in alone) for c in (0, 1)]
    of, cut_of = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for v, w in every - alone:
        for c in (0, 1):
            of[c][v] += n[c][v, w]
            cut_of[c][v] += min(n[c][v, w], d)

    def p(c, v, w):
        if v is None:
            return (max(n[c][None, w] - d, 0) + cut[c] * (n[0][None, w] + n[1][None, w]) / sum(total)) / total[c]
        if not of[c][v]:
            return p(c, None, w)
        return (max(n[c][v, w] - d, 0) + cut_of[c][v] * p(c, None, w)) / of[c][v]
    out = {e: math.log(p(1, *e) / p(0, *e)) for e in every if n[1][e] > d}
    return {e: r for e, r in out.items() if r > expressions.EXCESS}


def brute_features(text, model, known):
    """The scores of one text, its expressions looked up in {key: (pair, ratio)}."""
    key, before, _ = expressions.expressions(text)
    found = [known[k] for k in key.tolist() if k in known]
    alone = [r for pair, r in found if not pair]
    above = sum(r - expressions.EXCESS for r in alone) / math.sqrt(max(1, int((before == 0).sum())))
    words = [max(alone, default=0), max((r for pair, r in found if pair), default=0), above]
    return np.concatenate([toxicity.scores(text, model.ratio), [max(w, 0) for w in words]])


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def test_words_and_expressions_of_any_script():
    assert expressions.words("Don't ÉTÉ_2 пример 你好 ไท") == ["don", "t", "été", "2", "пример", "你", "好", "ไ", "ท"]
    key, before, word = expressions.expressions("你好 你 a b a")
    assert len(key) == 6 and (before == 0).sum() == 4 and len(set(word.tolist())) == 4  # 你好 and 好你
    for empty in (None, "", " ..\n"):
        assert [len(c) for c in expressions.expressions(empty)] == [0, 0, 0]
    assert len(expressions.expressions("one")[0]) == 1


def test_leaning_against_dictionaries(spark, docs, labels):
    rng = random.Random(3)
    common = [f"w{k}" for k in range(40)] + list("老人回家在磨坊边的树下")
    rows = []
    for k in range(400):
        w = rng.choices(common, k=20)
        toxic = int(k % 4 == 0)
        if toxic:
            w[3:6] = ["bad", "蠢", rng.choice("货人")]
        if rng.random() < 0.1:
            w[8] = "蠢" if not toxic else "odd"
        rows.append((k, " ".join(w), toxic))
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fitting = [(t, x) for k, t, x in rows if zlib.crc32(str(k).encode()) % 4 in toxicity.FIT]
    want = {key_of(*e): (e[0] is not None, r) for e, r in brute_leaning(fitting).items()}
    counted = toxicity.counts(made.select("doc_id", "text"), made.select("doc_id", "toxic"))
    got = {r["key"]: (r["pair"], r["ratio"]) for r in
           expressions.leaning(counted.filter(F.col("kind") == toxicity.BY_WORD)).collect()}
    assert {True, False} == {pair for pair, _ in want.values()} and set(got) == set(want)
    for k, (pair, ratio) in want.items():
        assert got[k] == (pair, pytest.approx(ratio, abs=2e-6))


def test_scores_against_a_lookup_of_every_expression(docs, labels):
    """The Bloom filter, the joins and the copies of a text change nothing."""
    model = toxicity.fit(docs, labels)
    known = {r["key"]: (r["pair"], r["ratio"]) for r in model.leaning.collect()}
    twice = docs.unionByName(docs.filter("doc_id % 7 = 0"))
    got = toxicity.features(twice, model, ["doc_id"]).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(got) == twice.count()
    for r in got:
        assert r["x"] == pytest.approx(brute_features(texts[r["doc_id"]], model, known), abs=1e-5)


@pytest.mark.parametrize("plain, bad", [
    ("старый человек пошёл домой и спал под деревом возле мельницы с двумя собаками".split(), ["гадкий", "подлец"]),
    (list("老人回家在磨坊边的树下和两只狗一起睡觉天气很好水也清"), ["混蛋", "蠢货"])])
def test_other_scripts(spark, plain, bad):
    """Toxic words of other scripts, made of letters that clean texts have too, are found in held-out texts."""
    rng = random.Random(2)
    blank = " " if len(plain[0]) > 1 else ""
    letters = plain if blank else plain + list("".join(bad))

    def text(toxic):
        w = rng.choices(letters, k=40)
        for k in range(2 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        out = blank.join(w)
        return text(toxic) if not toxic and any(b in out for b in bad) else out  # by chance, of its letters
    rows = [(k, text(k % 4 == 0)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(1500)], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity(docs, labels).collect() if r["held_out"]]
    wrong = Counter(r["doc_id"] % 4 == 0 for r in got if r["predicted"] != int(r["doc_id"] % 4 == 0))
    total = Counter(r["doc_id"] % 4 == 0 for r in got)
    assert wrong[True] <= 0.05 * total[True] and wrong[False] <= 0.05 * total[False]


def test_the_table_grows_with_the_corpus(spark):
    def leaning(n):
        rows = [(k, f"plain words of text {k % 5} " + (f"curse{k % (n // 24)}" if k % 3 == 0 else "mild"), int(k % 3 == 0))
                for k in range(n)]
        made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        return toxicity.fit(made.select("doc_id", "text"), made.select("doc_id", "toxic")).leaning.count()
    assert leaning(4800) > 3 * leaning(1200)


def test_no_toxic_copy_is_kept(spark, docs, labels):
    """Every row of a rejected text goes, whatever its id, and no other."""
    some = docs.withColumn("_h1", F.lit("own")).unionByName(docs.withColumn("_h1", F.lit("own")).withColumn("doc_id", F.lit(5).cast("long")))
    model = toxicity.fit(some, labels)
    rows = toxicity.with_score(some, model, ["text"]).collect()
    want = Counter(r["text"] for r in rows if r["score"] < 0.3)
    kept = toxicity.without_toxic(some, labels)
    assert kept.columns == some.columns and Counter(r["text"] for r in kept.select("text").collect()) == want
