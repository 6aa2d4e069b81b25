"""Spelling variants against every pair of words compared; the affected-gram bound against every edit."""
import random
import re
import zlib
from collections import Counter

import pytest

from feedlens.llm import spelling


def counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            out[low] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = counts(rows)
    near = {w: [v for v in n if is_near(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def got(docs, **kw):
    rows = spelling.variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {tuple(r) for r in rows}


def edits(rng, w, letters):
    i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
    if kind == 0 or i == len(w):
        return w[:i] + rng.choice(letters) + w[i:]
    return w[:i] + (rng.choice(letters) if kind == 1 else "") + w[i + 1:]


def corpus(seed, letters="abcéßÿÀn", n=250):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 14))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = [rng.choice(base[:1 + i % 25]) for _ in range(30)]
        rows.append((i % 200, " ".join(edits(rng, w, letters) if rng.random() < .12 else w for w in words)))
    return rows


@pytest.mark.parametrize("kw", [{}, {"often": 3}, {"often": 3, "most": 40, "longest": 7}, {"most": 0},
                                {"often": 3, "lists": 4}])
def test_variants(spark, kw):
    """Any dictionary gives the same result: pruned hard, cut short or empty."""
    rows = corpus(7)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), **kw) == brute(rows)


def test_repetitive_words(spark):
    """Words of one letter and short periods, where grams repeat within a word."""
    rng = random.Random(2)
    base = ["a" * k for k in range(6, 14)] + ["ab" * k for k in range(3, 7)] + ["aab" * 4, "abab" * 3 + "b"]
    rows = [(i, " ".join(edits(rng, w, "ab") if rng.random() < .4 else w for w in rng.choices(base, k=20)))
            for i in range(150)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), often=2) == brute(rows)


def test_chain_of_forms(spark):
    rows = [(1, " ".join(["aaaaaaa"] * 2 + ["aaaaaab"] * 25 + ["aaaaabb"] * 300 + ["aaaabbb"] * 3500))]
    rows += [(2, "aaaaaaa " * 2)]
    out = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out == brute(rows)
    assert {r[2] for r in out if r[0] in ("aaaaaab", "aaaaabb")} == {"aaaabbb"}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(odd_docs) == brute(rows)
    assert got(no_docs) == set()
    long_run = [(1, "x" * 50_000 + " " + "x" * 49_999), (2, "x" * 50_000 + " " + "x" * 49_999), (3, None)]
    assert got(spark.createDataFrame(long_run, "doc_id long, text string")) == brute(long_run)


def test_bound_holds_for_every_edit():
    """What an edit leaves: at least all grams but the bound, at their place or behind the edit one place on."""
    rng = random.Random(11)
    for trial in range(20):
        letters = "ab" if trial % 2 else "abcde"
        sample = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(30)]
        c = Counter(g for w in sample for q in (2, 3, 4) for s in ["^" + w + "$"]
                    for g in (s[p:p + q] for p in range(len(s) - q + 1)) if rng.random() < .6)
        grams = spelling.Grams(dict(c))
        for w in sample:
            own, worst = grams.decompose(w)
            for i in range(len(w) + 1):
                for other in {w[:i] + x + w[i:] for x in letters} | (
                        {w[:i] + x + w[i + 1:] for x in letters} | {w[:i] + w[i + 1:]} if i < len(w) else set()):
                    there = {(g, p) for _, g, p in grams.decompose(other)[0]}
                    move = len(other) - len(w)
                    kept = sum((g, p) in there if p <= i else (g, p + move) in there for _, g, p in own)
                    assert kept >= len(own) - worst
                    if other != w:
                        a, b = grams.leading(w), grams.leading(other)
                        if move < 0:
                            a, b = b, a
                        assert {(g, p + m) for g, p in a for m in (0, abs(move))} & set(b)


def test_one_edit_on_arrays():
    import numpy as np
    rng = random.Random(8)
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    codes = np.array([np.frombuffer(w.encode("latin-1").ljust(6, b"\0"), np.uint8) for w in words])
    pairs = [(i, j) for i in range(120) for j in range(120) if len(words[j]) - len(words[i]) in (0, 1)]
    i, j = (np.array(x) for x in zip(*pairs))
    got = spelling._one_edit(codes[i], codes[j], np.array([len(words[b]) > len(words[a]) for a, b in pairs]))
    assert got.tolist() == [is_near(words[a], words[b]) for a, b in pairs]


def test_pairs_of_runs():
    import numpy as np
    i, j = spelling._pairs(np.array([1, 3, 2]))
    assert list(zip(i.tolist(), j.tolist())) == [(1, 2), (1, 3), (2, 3), (4, 5)]
