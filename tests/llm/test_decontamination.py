"""Retrieval against scoring every item, matches against plain shingle containment."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import decontamination as D
from feedlens.sources.tables import table


def brute_matches(docs, items):
    """Every (doc, item) of which a passage of 2 x width words from a multiple of width holds both parts."""
    width = max(len(D.words(t)) for _, t in items if len(D.words(t)) >= 5)
    out = set()
    for doc_id, text in docs:
        w = D.words(text)
        for start in range(0, len(w) + 1, width):
            have = w[start:start + 2 * width]
            joined = " " + " ".join(have) + " "
            for item_id, item in items:
                if len(D.words(item)) < 5:
                    continue
                ok = True
                for part in D.question_and_answer(item):
                    n = min(5, len(part))
                    grams = {" ".join(part[i:i + n]) for i in range(len(part) - n + 1)}
                    ok &= sum(f" {g} " in joined for g in grams) >= 0.8 * len(grams)
                if ok:
                    out.add((doc_id, item_id))
    return out


def test_documents(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = brute_matches([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = D.matches(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 0
    kept = {r["doc_id"] for r in D.clean(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


@pytest.fixture(scope="module")
def index():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    weight = [1 / (k + 1) for k in range(300)]
    return D.build([(k, " ".join(rng.choices(vocabulary, weight, k=rng.randint(5, 40)))) for k in range(150)])


def test_wand_retrieves_all_above_threshold(index):
    rng = random.Random(3)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.lists)), rng.randint(0, 60)))
        score = np.zeros(len(index.ids))
        for t in terms:
            score[index.lists[t].items] += index.lists[t].weights
        for threshold in (0.2, 0.4, 0.6):
            got = dict(D.block_max_wand(index, terms, threshold))
            assert got.keys() == set(np.flatnonzero(score >= threshold - 1e-9).tolist())
            assert all(score[k] == pytest.approx(v) for k, v in got.items())


def test_first_test_loses_no_passage(index):
    rng = random.Random(4)
    names = list(index.term)
    docs = [np.array([index.term[x] for x in rng.choices(names[:80], k=rng.randint(0, 400))], np.int64) for _ in range(60)]
    for threshold in (0.3, 0.6):
        got = set(D._suspects(index, docs, threshold))
        for d, t in enumerate(docs):
            for s in range(len(t) // index.width + 1):
                terms = np.unique(t[s * index.width:(s + 2) * index.width])
                score = np.zeros(len(index.ids))
                for x in terms:
                    score[index.lists[x].items] += index.lists[x].weights
                assert (score < threshold).all() or (d, s) in got


ITEM = "Which river runs past the old mill of Arden? The slow river Tamble."


def test_plants_and_clean_texts(spark):
    filler = "some words that mean nothing much at all here " * 40
    rows = [(1, filler + ITEM + filler), (2, filler), (3, ITEM.upper().replace(" ", "\n")),
            (4, "Which river runs past the old mill of Arden? Nobody knows."), (5, None), (6, ""), (7, ITEM), (7, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, "of the"), (13, None), (14, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.matches(docs, bench).collect())
    assert got == [(1, 10), (1, 11), (3, 10), (3, 11), (7, 10), (7, 10), (7, 11), (7, 11)]
    assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == [2, 4, 5, 6]


def test_edge_cases(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in D.matches(odd_docs, bench).collect()) == [1, 1, 7]
    assert D.clean(odd_docs, bench).columns == odd_docs.columns
    assert D.matches(no_docs, bench).count() == 0
    none = bench.filter("false")
    assert D.matches(odd_docs, none).count() == 0 and D.clean(odd_docs, none).count() == odd_docs.count()


def test_parts_give_the_same_matches(spark, sf_dir, monkeypatch):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    whole = {(r["doc_id"], r["item_id"]) for r in D.matches(docs, bench).collect()}
    monkeypatch.setattr(D, "PART_WORDS", 500)
    assert len(list(D.indexes(bench))) > 1
    assert {(r["doc_id"], r["item_id"]) for r in D.matches(docs, bench).collect()} == whole


def test_edited_copies_of_every_item(spark, sf_dir):
    """One word of an item changed: found whenever retrieved and 0.8 of the item's shingles, or of both parts', are left."""
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    index = D.build(items)
    seen = {True: 0, False: 0}
    for k, item_id in enumerate(index.ids):
        w = index.whole[k]
        for at in range(0, len(w), 3):
            copy = [*w[:at], "zzz", *w[at + 1:]]
            share = sum(float(p.weights[p.items == k].sum()) for p in (index.lists[index.term[x]] for x in {*copy} - {"zzz"}))
            have = " " + " ".join(copy) + " "

            def left(part):
                grams = {" ".join(g) for g in D.shingles(part)}
                return sum(f" {g} " in have for g in grams) >= 0.8 * len(grams)
            want = share >= D.THRESHOLD and (left(w) or all(map(left, index.parts[k])))
            got = any(i == item_id for _, i, *_ in D.search(index, ["before " + " ".join(copy) + " after"]))
            assert got == want, (item_id, at)
            seen[want and not all(map(left, index.parts[k]))] += 1
    assert seen[True] > 0


def test_short_and_unspaced_items(spark):
    """Items of three and four words, and of scripts without blanks, are found where their words follow each other."""
    items = [(1, "purple monkey dishwasher"), (2, "その川は古い水車小屋のそばを流れる"), (3, "two words"), (4, "Who knows? Nobody at all."),
             (5, "小川流水"), (6, "แม่น้ำไหลผ่านโรงสีเก่า")]
    docs = [(1, "we saw a Purple, monkey dishwasher there"), (2, "purple dishwasher monkey"), (3, "昔、その川は古い水車小屋のそばを流れると言う"),
            (4, "just two words here"), (5, "who knows, nobody at all"), (6, "nobody knows at all who"), (7, "前小川流水後"), (8, "小流川水"),
            (9, "กาลครั้งหนึ่งแม่น้ำไหลผ่านโรงสีเก่ามาก"), (10, "川は流れる")]
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"),
                    spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (3, 2), (5, 4), (7, 5), (9, 6)}


def test_parts_change_nothing(spark, sf_dir, monkeypatch):
    """Scores and matches are the same however many parts the index is cut into."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    bench = bench.unionByName(bench.limit(5).withColumn("item_id", F.lit(1).cast("long")))  # ids that repeat
    whole = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in D.matches(docs, bench).collect()}
    monkeypatch.setattr(D, "PART_WORDS", 500)
    assert len(list(D.indexes(bench))) > 3
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in D.matches(docs, bench).collect()} == whole
