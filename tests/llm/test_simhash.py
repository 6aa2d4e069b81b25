"""SimHash against a bit-by-bit version, linking against all pairs."""

import random

import xxhash
from pyspark.sql import functions as F

from feedlens.llm import simhash
from feedlens.sources.tables import table


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def expect(rows):
    fp = [(d, brute_fingerprint(t)) for d, t in rows]
    root = brute_components(sorted({f for _, f in fp}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in fp:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in fp), key=repr)


def got(docs):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"])
                   for r in simhash.near_duplicates(docs).collect()), key=repr)


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(docs) == expect([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd_docs, no_docs):
    assert got(odd_docs) == expect([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert got(no_docs) == []


def test_hash_is_sparks_xxhash64(spark):
    df = spark.createDataFrame([("Grüße an alle Leser",)], "text string")
    h = df.select(F.xxhash64(F.lower("text"))).first()[0]
    assert signed(simhash.fingerprint("GRüße\tan alle", 3)) == df.select(F.xxhash64(F.lit("grüße an alle"))).first()[0]
    assert isinstance(h, int)


def test_links_give_the_components_of_all_pairs(spark):
    """Planted chains: each fingerprint one to three bits from an earlier one, in large cells."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(450):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    old, simhash.TILE = simhash.TILE, 16
    try:
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    finally:
        simhash.TILE = old
    root = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    want, have = {}, {}
    for x in fps:
        want.setdefault(root[x], set()).add(x)
        have.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_long_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[k] for k in range(61)} == {0} and {roots[k] for k in range(1000, 1100)} == {1000}


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 2, 5, 8, 9]
    assert [r["text"] for r in rows if r["doc_id"] is None] == ["stray words here"]
    assert all(r["_nth"] == "own _nth" and r["_row"] == "own _row" for r in rows)
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_with_repeated_ids(spark):
    """One row of each component, told by id and text: a repeated id loses no text of its own."""
    a, b = "one two three four five", "six seven eight nine ten"
    rows = [(5, a, 1), (5, b, 2), (6, a, 3), (7, b, 4), (None, b, 5), (None, "quite alone it is", 6), (5, a, 7)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "quite alone it is"), (5, a), (5, b)]
