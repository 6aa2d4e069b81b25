"""The Jaccard join against every pair compared, also with bounds so small that every hot path is taken."""
import random
import re

import pytest

from feedlens.llm import jaccard


def _sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute(rows, width=4, num=85, den=100):
    """[(doc_id, n, component)] by comparing all pairs."""
    sets = [_sets(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * len(a | sets[j]):
                label[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [r[0] for k, r in enumerate(rows) if root(k) == root(i) and r[0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return out


def _key(r):
    return tuple((x is None, x or 0) for x in r)


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.similar(docs, **kw).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=_key) == sorted(brute(rows), key=_key)


def _varied(rng, n, families, length=60):
    """Texts of a few families, each copy with up to five changed, cut or added words, some repeated."""
    stock = [[f"w{rng.randrange(3000)}" for _ in range(length + 20 * f)] for f in range(families)]
    rows = []
    for i in range(n):
        words = list(stock[rng.randrange(families)])
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], [f"x{rng.randrange(10 ** 6)}"], [words[at], f"y{rng.randrange(10 ** 6)}"]])
        rows.append((rng.randrange(n), " ".join(words[rng.randrange(2):])))
    return rows


#: Bounds that cut every column of more than five documents and every component of more than six.
TINY = jaccard.Sizes(tile=5, sets=6, items=500, run=16)


@pytest.mark.parametrize("sizes", [jaccard.Sizes(), TINY])
def test_near_copies(spark, sizes):
    rows = _varied(random.Random(1), 150, 4) + _varied(random.Random(2), 40, 3, length=9)
    check(spark, rows, sizes=sizes)


def test_common_passage(spark):
    """A passage in most documents links only those that it nearly fills."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 40))))
            for i in range(120)]
    check(spark, rows, sizes=TINY)


def test_threshold_is_exact(spark):
    """17 of 20 common shingles link, 17 of 21 do not; a hub joins texts that are not alike."""
    base = [f"a{k}" for k in range(40)]
    rows = [(1, " ".join(base[:20])), (2, " ".join(base[:23])),            # 17 and 20 shingles, 17 common
            (3, " ".join(base[:24])),                                       # 21 shingles: 17/21 and 20/21
            (4, " ".join(["q"] + base[:23])), (5, " ".join(base[:2])), (6, " ".join(base[:2]).upper())]
    check(spark, rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = [tuple(r) for r in jaccard.similar(odd_docs).collect()]
    assert sorted(got, key=_key) == sorted(brute(rows), key=_key)
    assert jaccard.similar(no_docs).collect() == []


def test_repeated_ids_with_other_texts(spark):
    check(spark, [(5, "a b c d e"), (5, "f g h i j"), (6, "a b c d e"), (7, "f g h i j"), (None, "f g h i j"),
                  (None, "z z z z z"), (8, "z z z z z z z z")])


def test_product_drops_rows_that_cannot_reach():
    import numpy as np
    rng = np.random.default_rng(0)
    share = jaccard.Share(85, 100)
    base = rng.integers(0, 1 << 62, 9000).astype(np.uint64)
    items = [np.unique(np.concatenate([rng.choice(base, k, replace=False), base[:b]]))
             for k, b in [(10, 8000), (500, 8000), (3000, 2000), (100, 8500), (4000, 0), (8000, 0)]]
    i, j = jaccard._product(np.array([len(x) for x in items]), items, share)
    want = [(a, b) for a in range(6) for b in range(a + 1, 6)
            if 100 * len(np.intersect1d(items[a], items[b])) >= 85 * len(np.union1d(items[a], items[b]))]
    assert list(zip(i.tolist(), j.tolist())) == want


def test_parities_keep_every_pair_that_reaches():
    """The bound from parities lets each pair through that reaches the share, and few of the others."""
    import numpy as np
    rng = np.random.default_rng(5)
    share = jaccard.Share(85, 100)
    passage = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    items = [np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (1, 2, 7, 64, 65, 130, 500, 2000)]
    items += [x[:round(len(x) * cut)] for x in items for cut in (1, 0.99, 0.9, 0.86, 0.84) if round(len(x) * cut)]
    items += [np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, 300).astype(np.uint64)])) for _ in range(20)]
    n = np.array([len(x) for x in items])
    i, j = jaccard._close(n, [jaccard._parity(x) for x in items], share)
    got = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
    both = [(a, b) for a in range(len(items)) for b in range(a)]
    reach = {frozenset(p) for p in both if 100 * len(np.intersect1d(*(items[k] for k in p))) >= 85 * len(
        np.union1d(*(items[k] for k in p)))}
    assert reach <= got and len(got) == len(i)
    assert not [p for p in got if min(p) >= len(items) - 20]


def test_linked_tiles_are_passed_over():
    """A group of near copies costs a row of tiles, not all pairs of tiles; the links are the same."""
    import numpy as np
    n, calls = np.full(400, 100), []

    def near(rows):
        calls.append(len(rows))
        i, j = np.nonzero(np.triu((rows[:, None] - rows[None, :]) % 2 == 0, 1))
        return i, j
    for side in (np.zeros(400, int), np.repeat([0, 1], 200)):
        calls.clear()
        i, j = jaccard._linked(n, side, near, jaccard.Share(85, 100), jaccard.Sizes(sets=10))
        assert len(i) == 398 and (i % 2 == j % 2).all()
    calls.clear()
    jaccard._linked(n, np.zeros(400, int), lambda r: (calls.append(1), np.nonzero(np.triu(np.ones((len(r),) * 2), 1)))[1],
                    jaccard.Share(85, 100), jaccard.Sizes(sets=10))
    assert len(calls) == 40  # of 820 pairs of tiles


def test_texts_go_to_few_blocks(spark, monkeypatch):
    """Texts that only share a passage are not shuffled, and each of a large group goes to a few pairs of blocks."""
    sent = []
    needed = jaccard._needed_texts

    def seen(docs, plan):
        sent.extend(len(r["ends"]) for r in plan.collect())
        return needed(docs, plan)
    monkeypatch.setattr(jaccard, "_needed_texts", seen)
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    alone = [(i, " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(30)) + f" {passage} "
              + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(30))) for i in range(150)]
    stock = [f"w{rng.randrange(3000)}" for _ in range(200)]
    group = [(1000 + i, " ".join(stock[:k] + [f"x{i}"] + stock[k + 1:])) for i, k in enumerate(rng.choices(range(200), k=90))]
    check(spark, alone + group, sizes=TINY)
    assert len(sent) <= 95 and max(sent) <= 13, (len(sent), max(sent))
