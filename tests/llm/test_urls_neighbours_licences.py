"""URL rules, nearest neighbours and licences against plain Python."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import licences, neighbours, urls
from feedlens.sources.tables import table

SF = "/root/testdata/sf0.01"


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


ODD = ["http://www.example.com/en/x", "http://EXAMPLE.com/en/", "https://example.com/english", "http://notexample.com/en/",
       "http://a.net/es/1?x=1&y=2#z", "http://a.net/fr", "http://a.net?q=/es/", "HTTP://x.NET/fr/a//b", "no scheme", "", None,
       "://", "http://", "http://com/", "http://com", "a://b://c.com/d", "http://é.com/\nx", "http://a.net/es/" + "x" * 20000]


def test_hosts_paths_and_rules(spark):
    pages = table(spark, SF, "pages").select("page_id", "url")
    odd = spark.createDataFrame([(10_000 + k, u) for k, u in enumerate(ODD)], "page_id long, url string")
    every = pages.unionByName(odd).unionByName(odd)
    got = urls.verdicts(every.withColumn("host", F.lit("own"))).collect()
    assert len(got) == every.count()
    url_of = {r["page_id"]: r["url"] for r in every.collect()}
    for r in got:
        host, path, best = brute_url(url_of[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1]), url_of[r["page_id"]]
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")
        assert 0 <= r["score"] <= 1


def test_trees_learn_held_out_rules(spark):
    """Hide a tenth of the labelled URLs behind a scheme that no rule fits: the trees find their class."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    rules = [("block", "net/"), ("allow", "com/"), ("allow", "org/")]
    hidden = pages.withColumn("url", F.when(F.col("page_id") % 10 == 0, F.regexp_replace("url", r"(example\.\w+)/", "$1:80/")).otherwise(F.col("url")))
    rows = urls.verdicts(hidden, rules).filter("rule is null").collect()
    right = sum((".net:80" in r["host"]) == (r["verdict"] == "block") for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.6


def test_features(spark):
    u = "https://a-b.example.co.uk/x/y2.html?p=1&q=&&r#t"
    df = spark.createDataFrame([(1, u)], "page_id long, url string")
    r = urls.features(urls.parsed(df)).first()
    share = [u.count(c) / len(u) for c in set(u)]
    assert r["f_entropy"] == pytest.approx(-sum(p * math.log2(p) for p in share))
    assert (r["f_params"], r["f_depth"], r["f_labels"], r["f_hyphens"], r["f_fragment"], r["f_extension"]) == (3, 2, 4, 1, 1, 1)
    assert r["f_digits"] == pytest.approx(2 / len(u)) and r["suffix"] == "uk"


def test_urls_without_classes(spark):
    none = spark.createDataFrame([(1, "x"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.verdicts(none).collect()} == {"allow"}
    only = spark.createDataFrame([(1, "http://a.net/es/"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.verdicts(only).collect()} == {"block"}
    assert urls.verdicts(none.filter("false")).count() == 0


def brute_nearest(rows, every=20, top=20):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    out = {}
    for k, q in enumerate(ids):
        if q % every == 0:
            s = x @ x[k]
            order = sorted((i for i in range(len(ids)) if i != k), key=lambda i: (-round(s[i], 12), ids[i]))
            out[q] = [ids[i] for i in order[:top]]
    return out


def found(df, **kw):
    out = {}
    for r in sorted(neighbours.nearest(df, **kw).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({v for _, v, _ in got.get(q, [])} & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_embeddings(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FEW", 0)
    monkeypatch.setattr(neighbours, "BLOCK", 32)  # many blocks, so that windows count
    monkeypatch.setattr(neighbours, "CHUNK", 2)
    df = table(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    x = {i: np.array(v, np.float64) for i, v in rows}
    got, want = found(df), brute_nearest(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, hits in got.items():
        assert [r for r, _, _ in hits] == list(range(1, 21))
        assert all(s == pytest.approx(float(x[q] @ x[v]), abs=1e-12) for _, v, s in hits)
        assert hits == sorted(hits, key=lambda h: (-h[2], h[1]))


def test_windows_stay_small_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(30, 12)) * 4
    x = (centre[rng.integers(0, 30, 900)] + rng.normal(size=(900, 12)) * 0.2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(df, top=5), brute_nearest(rows, top=5)
    assert recall(got, want) >= 0.9


def test_inner_product_of_unequal_norms(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.1, 5, size=(400, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(found(df), brute_nearest(rows)) >= 0.9


def test_copies_and_unusable_vectors(spark):
    one, two = [1.0, 0.0], [0.6, 0.8]
    rows = [(k, one) for k in range(0, 60)] + [(100, two), (101, None), (102, []), (103, [0.0, 0.0]), (104, [1.0, None]),
                                               (105, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, [1.0, 2.0, 3.0]),
                                               (None, one), (100, two)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit("own"))
    got = found(df)
    assert got.keys() == {0, 20, 40, 100}
    for q in (0, 20, 40):
        assert [v for _, v, _ in got[q]] == [k for k in range(22) if k != q][:20]
    assert [v for _, v, _ in got[100]] == list(range(20)) and got[100][0][2] == pytest.approx(0.6)
    few = found(df.filter("vec_id = 0 or vec_id = 100"))
    assert {q: [v for _, v, _ in h] for q, h in few.items()} == {0: [100], 100: [0]}
    assert found(df.filter("false")) == {} and found(df.filter("vec_id = 20")) == {}


@pytest.mark.parametrize("few", [0, 4096])
def test_mixed_lengths_and_repeated_ids(spark, monkeypatch, few):
    """Every length is searched among its own; an id with several vectors is a query and a candidate with each."""
    monkeypatch.setattr(neighbours, "FEW", few)
    rng = np.random.default_rng(3)
    rows = [(k % 150, rng.normal(size=3).tolist()) for k in range(200)] + [(k, rng.normal(size=2).tolist()) for k in range(60)]
    rows += [(k, rng.normal(size=5).tolist()) for k in range(0, 40, 10)] + [(20, rows[20][1])] * 50
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>"), top=4).collect())
    want, one = [], sorted({(i, tuple(v)) for i, v in rows})
    for i, v in one:
        if i % 20 == 0:
            near = sorted((-round(float(np.dot(v, w)), 9), j) for j, w in one if len(w) == len(v) and (j, w) != (i, v))
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(near[:4])]
    assert {(q, r) for q, r, *_ in got} == {(q, r) for q, r, *_ in want} and len(got) == len(want)
    assert len(set(got) & set(want)) >= 0.9 * len(want)


def test_hilbert_visits_neighbouring_cells():
    for axes, bits in ((2, 4), (3, 3), (1, 5)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * axes)).reshape(axes, -1).T
        order = np.argsort(neighbours.hilbert(cells, bits))
        assert sorted(neighbours.hilbert(cells, bits).tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def files(spark, rows):
    return spark.createDataFrame(rows, "id long, path string, text string")


MIT = "Released under the MIT License."
GPL = "This work is licensed under the GNU General Public License, version 3."
PLAIN = "nothing but words about boats and rivers"


def test_inheritance_from_the_nearest_directory(spark):
    rows = [(1, "LICENSE", MIT), (2, "a/b/COPYING", GPL), (3, "a/x.py", PLAIN), (4, "a/b/c/d.py", PLAIN),
            (5, "a/b/own.py", f"{PLAIN}\n{MIT}\n" + PLAIN * 50), (6, None, None), (7, "z/empty", ""), (8, "a/b", PLAIN), (9, "ab/f", PLAIN)]
    rows += [(100 + k, f"q/{k}", PLAIN) for k in range(200)]
    got = {r["id"]: r for r in licences.scan(files(spark, rows), "id").collect()}
    assert len(got) == len(rows)
    assert [(got[k]["licence"], got[k]["inherited_from"]) for k in (3, 4, 6, 7, 8, 9)] == [
        ("MIT", ""), ("GPL-3.0", "a/b"), ("MIT", ""), ("MIT", ""), ("MIT", ""), ("MIT", "")]
    assert (got[5]["licence"], got[5]["inherited_from"], got[5]["is_licence_file"]) == ("MIT", None, False)
    assert got[2]["is_licence_file"] and got[2]["own_licence"] == "GPL-3.0"


def test_cosine_is_sparse_tf_idf():
    m = licences.Matcher([("A", "red green blue"), ("B", "red stone")], {"red": 5, "green": 1}, 9)
    idf = {"red": math.log(10 / 6) + 1, "green": math.log(10 / 2) + 1, "blue": math.log(10) + 1, "stone": math.log(10) + 1, "sky": m.rare}
    a = np.array([idf["red"], idf["green"], idf["blue"], 0])
    q = np.array([idf["red"], 2 * idf["green"], 0, idf["sky"]])
    score, name = m.best("green red green sky".split())
    assert name == "A" and score == pytest.approx(a @ q / np.linalg.norm(a) / np.linalg.norm(q))


def test_licences_of_documents(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r["own_licence"] for r in licences.scan(licences.as_files(docs), "doc_id").collect()}
    by_line = {name: text for name, text in licences.TEMPLATES if len(text) < 80}
    for r in docs.collect():
        lines = [x.strip() for x in r["text"].split("\n")]
        names = {name for name, text in by_line.items() if text in lines}
        assert (got[r["doc_id"]] in names) if names else True
    assert sum(v is not None for v in got.values()) > 0


def test_licence_edge_cases(spark, odd_docs, no_docs):
    assert licences.scan(licences.as_files(odd_docs), "doc_id").count() == odd_docs.count()
    assert licences.scan(licences.as_files(no_docs), "doc_id").count() == 0


def test_notices_that_many_texts_carry(spark):
    """A third of all texts, or two of a few, carry one notice: each of them has that licence and gives it on."""
    rows = [(k, f"s{k}/x", f"{PLAIN} {k}\n{MIT if k % 3 == 0 else PLAIN}\n" + PLAIN * 9) for k in range(300)]
    rows += [(900, "d/LICENSE", MIT), (901, "d/e/x.py", PLAIN)]
    got = {r["id"]: r for r in licences.scan(files(spark, rows), "id").collect()}
    assert [k for k in range(300) if got[k]["own_licence"] == "MIT"] == list(range(0, 300, 3))
    assert got[900]["is_licence_file"] and (got[901]["licence"], got[901]["inherited_from"]) == ("MIT", "d")
    few = [(1, "a/x", f"{PLAIN}\n{GPL}"), (2, "b/x", f"{GPL}\n{PLAIN}"), (3, "c/x", PLAIN)]
    got = {r["id"]: r["licence"] for r in licences.scan(files(spark, few), "id").collect()}
    assert got == {1: "GPL-3.0", 2: "GPL-3.0", 3: None}


def test_pruning_keeps_the_best_cosine():
    rng = np.random.default_rng(5)
    names = sorted({w for _, t in licences.TEMPLATES for w in licences.words(t)}) + [f"x{k}" for k in range(40)]
    m = licences.Matcher(licences.TEMPLATES, {w: int(rng.integers(1, 900)) for w in names}, 1000)
    for _ in range(200):
        lines = [list(rng.choice(names, rng.integers(1, 9))) for _ in range(rng.integers(1, 6))]
        flat = [x for w in lines for x in w]
        want = max(m.best(w)[0] for w in [*lines, flat])
        assert m.scan("\n".join(" ".join(w) for w in lines))[1] == pytest.approx(want)


def test_full_licence_texts_are_licence_files(spark):
    """Whole licences of up to thousands of words, with an owner's line, give their directories a licence."""
    assert {"MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "MPL-2.0"} <= {name for name, _ in licences.TEXTS}
    rows = [(k, f"{name}/LICENSE", f"Copyright (c) 2024 Some Owner\n\n{text}") for k, (name, text) in enumerate(licences.TEXTS)]
    rows += [(100 + k, f"{name}/src/x.py", f"{PLAIN} {k}") for k, (name, _) in enumerate(licences.TEXTS)]
    rows += [(200 + k, f"plain/{k}", f"{PLAIN} {k}\n" * 900) for k in range(100)]
    rows += [(400, "quoting/x.py", f"{MIT}\n" + f"{PLAIN}\n" * 900)]
    got = {r["id"]: r for r in licences.scan(files(spark, rows), "id").collect()}
    for k, (name, _) in enumerate(licences.TEXTS):
        assert (got[k]["own_licence"], got[k]["is_licence_file"]) == (name, True)
        assert (got[100 + k]["licence"], got[100 + k]["inherited_from"]) == (name, name)
    assert all(got[200 + k]["licence"] is None for k in range(100))
    assert (got[400]["own_licence"], got[400]["is_licence_file"]) == ("MIT", False)


NOTICES = [(n, t) for n, t in licences.TEMPLATES if n in ("BSD-3-Clause", "GPL-3.0", "MIT", "ISC", "LGPL-2.1") and len(t) > 80]


@pytest.mark.parametrize("width", [30, 40, 60])
def test_notice_anywhere_in_a_long_comment(width):
    """A wrapped notice at every line of a paragraph longer than a window is found as that licence, or not at all
    where its lines are too few among the window's; never as another licence."""
    import textwrap
    for name, text in NOTICES:
        m = licences.Matcher(licences.TEMPLATES, {w: 3 for _, t in licences.TEMPLATES for w in licences.words(t)}, 1000)
        lines = textwrap.wrap(text, width)
        alone = m.scan("\n".join(lines))[0]
        for at in range(35, 45):
            filler = [f"q{k}" for k in range(at)]
            got = m.scan("\n".join([*filler, *lines, *[f"r{k}" for k in range(45 - at)]]))[0]
            assert got in (alone, None)
            block = m.scan("\n".join([*lines * (at // len(lines) + 1)]))[0]
            assert block == alone == name


def test_cut_does_not_lose_a_notice():
    """Notices one after the other in one paragraph: each window that holds a whole one is compared."""
    m = licences.Matcher(licences.TEMPLATES, {}, 50)
    bsd = dict((n, t) for n, t in licences.TEMPLATES if n == "BSD-3-Clause")["BSD-3-Clause"].split()
    lines = [" ".join(bsd[k:k + 3]) for k in range(0, len(bsd), 3)]
    for before in range(30, 45):
        text = "\n".join([*(["*"] * 2), *["***" for _ in range(before)], *lines])
        assert m.scan(text)[0] == "BSD-3-Clause"


def test_identifiers():
    m = licences.Matcher(licences.TEMPLATES, {"mit": 900, "spdx-license-identifier.mit": 400}, 1000)
    assert m.scan("x\n// SPDX-License-Identifier: MIT\ny")[0] == "MIT"
    assert m.scan("# spdx-license-identifier:   GPL-2.0-or-later")[0] == "GPL-2.0"
    assert m.scan("# SPDX-License-Identifier: Some-Other")[0] is None
    assert m.scan("Permission to use, copy, modify, and/or distribute this software for any purpose with or without\n"
                  "fee is hereby granted, provided that the above copyright notice and this permission notice appear in\n"
                  "all copies.")[0] == "ISC"


def test_inheritance_against_brute_force(spark):
    """Random trees of directories: the nearest ancestor with a licence file, by walking up each path."""
    import random
    rng = random.Random(6)
    names = [("MIT", "Released under the MIT License."), ("MPL-2.0", licences.TEMPLATES[10][1]), (None, "plain words only")]
    rows = []
    for k in range(400):
        parts = [f"d{rng.randrange(3)}" for _ in range(rng.randrange(5))]
        rows.append((k, "/".join([*parts, f"f{k}"]), rng.choice(names + names[2:] * 6)[1]))
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = {r["id"]: r for r in licences.scan(df, "id").collect()}
    own = {p: got[k]["own_licence"] for k, p, _ in rows}
    cosine = {p: got[k]["cosine"] for k, p, _ in rows}
    for k, p, t in rows:
        assert own[p] == dict((b, a) for a, b in names)[t]
    given_by = {}
    for k, p, t in rows:
        if own[p]:
            d = p.rpartition("/")[0]
            given_by.setdefault(d, []).append((-cosine[p], own[p], p))
    for k, p, t in rows:
        if own[p]:
            assert got[k]["licence"] == own[p] and got[k]["inherited_from"] is None
            continue
        d = p.rpartition("/")[0]
        while d not in given_by and d:
            d = d.rpartition("/")[0]
        want = min(given_by[d])[1] if d in given_by else None
        assert got[k]["licence"] == want and got[k]["inherited_from"] == (d if want else None)


def test_suffix_rates_come_from_other_folds(spark):
    """Labels that have nothing to do with the URL: where each suffix is one row's, its own label must not show."""
    import random
    rng = random.Random(3)
    rows = [(k, f"http://h{k}.{'net' if k % 2 else 'com'}{k}/{'es' if rng.random() < .5 else 'de'}/x") for k in range(400)]
    rules = [("allow", f"com{k}/") if rng.random() < .5 else ("block", f"com{k}/") for k in range(0, 400, 2)]
    rules += [("allow", f"net{k}/") if rng.random() < .5 else ("block", f"net{k}/") for k in range(1, 400, 2)]
    got = urls.verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    agree = sum((r["score"] >= 0.5) == (r["verdict"] == "block") for r in got) / 400
    assert len(got) == 400 and agree < 0.8
