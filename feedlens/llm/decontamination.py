"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then overlap.

Every document is cut into passages: windows of two consecutive segments, each as long as the longest
item, so that any occurrence of an item lies within one passage. A passage is a query of its distinct
words. An item's BM25 weights are scaled to sum to 1, so a score is the share of the item's weight
that the passage covers, and one threshold serves all items.

Retrieval is exact above the threshold. Words common to many items are the non-essential lists: their
weights can never lift an item over `COMMON_SHARE`. A first test, over all passages of a batch at once,
adds up only the essential lists and drops what stays below threshold minus the item's common weight.
Passages that remain run block-max WAND over all lists. What it retrieves is verified on five-word
shingles: at least `OVERLAP` of the whole item's, or of the question's and of the answer's each, must
occur in the passage. The answer is an item's last sentence, the question what comes before (both: the
whole item if it has one sentence only). One edit breaks most shingles of a short part, so the parts
alone would lose near copies. Words are runs of letters and digits, lower-cased; of scripts without blanks every
character is a word. An item of fewer than five words is found where its whole word sequence occurs.

The index is broadcast. It is cut into parts of about `PART_WORDS` words by a hash of the item, and every
part searches all documents. Document frequencies and the mean length are counted by Spark over all items, so
results do not depend on the parts; a part's items and their words' frequencies are all that the driver holds.

Edge cases: null and empty texts hold nothing; items of fewer than `SHORTEST` words identify no text and are
not searched; repeated items and documents match each on their own; an empty benchmark or document
table gives no matches; an item longer than PART_WORDS has a part to itself; extra columns are kept
by `clean` and ignored by `matches`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

K1, B = 1.2, 0.75
THRESHOLD = 0.6
COMMON_SHARE = 0.25
OVERLAP, SHINGLE, SHORTEST = 0.8, 5, 3
BLOCK = 16
PART_WORDS = 2_000_000
#: Words of a batch that are looked at together.
CHUNK_WORDS = 500_000

#: Scripts written without blanks: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_words = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+").findall
_sentence_end = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; of a shorter text its whole word sequence."""
    return {tuple(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in map(words, _sentence_end.split(text)) if w]
    if len(parts) < 2:
        return parts[0], parts[0]
    return [x for p in parts[:-1] for x in p], parts[-1]


@dataclass
class Postings:
    """One word's list: items in rising order, their weights, and each block's largest weight."""
    items: np.ndarray
    weights: np.ndarray
    most: float = 0.0
    block_most: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.most = float(self.weights.max())
        for i, w in zip(self.items.tolist(), self.weights.tolist()):
            self.block_most[i // BLOCK] = max(w, self.block_most.get(i // BLOCK, 0.0))


@dataclass
class Index:
    ids: list[int]
    term: dict[str, int]
    lists: list[Postings]
    essential: np.ndarray  # by term: its lists is added up in the first test
    common: np.ndarray  # by item: weight of its non-essential words
    parts: list[tuple[list[str], list[str]]]
    whole: list[list[str]]
    width: int  # words of a segment
    start: np.ndarray  # essential postings, concatenated: bounds by term, items, weights
    items: np.ndarray
    weights: np.ndarray


def build(rows: list[tuple[int, str]], counted: tuple[int, float, dict[str, int]] | None = None) -> Index | None:
    """Index (item_id, text) pairs; None if no item is long enough.

    `counted` has the number of all items, their mean length and the words' document frequencies; without it the
    rows are all items.
    """
    kept = [(i, t, w) for i, t, w in ((i, t, words(t)) for i, t in rows) if len(w) >= SHORTEST]
    if not kept:
        return None
    every, mean, df = counted or (len(kept), sum(len(w) for _, _, w in kept) / len(kept),
                                  Counter(x for _, _, w in kept for x in set(w)))
    n = len(kept)
    held = {x for _, _, w in kept for x in w}
    posting: dict[str, tuple[list[int], list[float]]] = {x: ([], []) for x in held}
    for k, (_, _, w) in enumerate(kept):
        weight = {x: math.log(1 + (every - df[x] + 0.5) / (df[x] + 0.5)) * f * (K1 + 1)
                  / (f + K1 * (1 - B + B * len(w) / mean)) for x, f in Counter(w).items()}
        total = sum(weight.values())
        for x, v in weight.items():
            posting[x][0].append(k)
            posting[x][1].append(v / total)
    names = sorted(held, key=lambda x: (-df[x], x))
    lists = [Postings(np.array(posting[x][0]), np.array(posting[x][1])) for x in names]
    common, essential = np.zeros(n), np.ones(len(names), bool)
    for k, p in enumerate(lists):  # most frequent first, as long as no item gets too much from them
        if (common[p.items] + p.weights).max() > COMMON_SHARE:
            break
        common[p.items] += p.weights
        essential[k] = False
    size = np.array([len(p.items) if e else 0 for p, e in zip(lists, essential)])
    some = [p for p, e in zip(lists, essential) if e]
    return Index([i for i, _, _ in kept], {x: k for k, x in enumerate(names)}, lists, essential, common,
                 [question_and_answer(t) for _, t, _ in kept], [w for _, _, w in kept], max(len(w) for _, _, w in kept),
                 np.concatenate([[0], np.cumsum(size)]),
                 np.concatenate([p.items for p in some]) if some else np.zeros(0, int),
                 np.concatenate([p.weights for p in some]) if some else np.zeros(0))


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (item, score) with a score of at least `threshold` for a query of distinct terms.

    Lists are kept by their current item. The pivot is the first item that the lists up to it could
    lift to the threshold; if the blocks that hold it can't, everything up to the nearest block end
    (or the next list's item) is skipped.
    """
    slack = threshold - 1e-9
    at = [[0, index.lists[t]] for t in terms]
    found = []
    here = lambda c: int(c[1].items[c[0]])

    def move(c: list, to: int) -> None:
        c[0] += int(np.searchsorted(c[1].items[c[0]:], to))

    while at:
        at.sort(key=here)
        bound, pivot = 0.0, -1
        for k, c in enumerate(at):
            bound += c[1].most
            if bound >= slack:
                pivot = here(c)
                break
        if pivot < 0:
            return found
        upto = [c for c in at if here(c) <= pivot]
        block = pivot // BLOCK
        if sum(c[1].block_most.get(block, 0.0) for c in upto) >= slack:
            if here(at[0]) == pivot:
                score = sum(float(c[1].weights[c[0]]) for c in upto)
                if score >= slack:
                    found.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
        else:
            rest = [here(c) for c in at if here(c) > pivot]
            to = min([(block + 1) * BLOCK, *rest])
        for c in upto:
            move(c, to)
        at = [c for c in at if c[0] < len(c[1].items)]
    return found


def _suspects(index: Index, docs: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """(document, passage) pairs that may hold an item, by the essential lists alone.

    A passage is numbered by its first segment.
    """
    seg_of, base = [], [0]
    for t in docs:
        seg_of.append(base[-1] + np.arange(len(t)) // index.width)
        base.append(base[-1] + len(t) // index.width + 2)  # a gap: passages end with their document
    term, seg = np.concatenate(docs), np.concatenate(seg_of)
    ok = term >= 0
    ok[ok] = index.essential[term[ok]]
    pair = np.unique(seg[ok] * len(index.lists) + term[ok])
    seg, term = pair // len(index.lists), pair % len(index.lists)
    size = index.start[term + 1] - index.start[term]
    if not size.sum():
        return []
    at = np.repeat(index.start[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    key, inv = np.unique(np.repeat(seg, size) * len(index.ids) + index.items[at], return_inverse=True)
    mass = np.bincount(inv, index.weights[at])
    item = key % len(index.ids)
    # a passage's mass is at most the sum of its two segments'; a segment alone counts for both its passages
    n, rest = len(index.ids), threshold - 1e-9 - index.common[item]

    def beside(step: int) -> np.ndarray:
        other = np.searchsorted(key, key + step).clip(0, len(key) - 1)
        return np.where(key[other] == key + step, mass[other], 0.0)

    first, second = mass + beside(n) >= rest, mass + beside(-n) >= rest
    seg = np.unique(np.concatenate([key[first] // n, key[second] // n - 1]))
    doc = np.searchsorted(base, seg, side="right") - 1
    seg = seg - np.array(base)[doc.clip(0)]
    real = (doc >= 0) & (seg <= np.array([len(t) // index.width for t in docs])[doc.clip(0)])
    return list(zip(doc[real].tolist(), seg[real].tolist()))


def _overlap(part: list[str], passage: list[str]) -> float:
    want = shingles(part)
    width = min(SHINGLE, len(part))
    have = {tuple(passage[i:i + width]) for i in range(len(passage) - width + 1)}
    return len(want & have) / len(want)


def search(index: Index, texts: list[str | None], threshold: float = THRESHOLD) -> Iterator[tuple]:
    """(position, item_id, score, question overlap, answer overlap) of each verified match.

    A text that holds an item in several passages gives its best passage.
    """
    start = 0
    get = index.term.get
    while start < len(texts):
        docs, n = [], 0
        while start + len(docs) < len(texts) and n < CHUNK_WORDS:
            w = words(texts[start + len(docs)])
            docs.append(np.fromiter((get(x, -1) for x in w), np.int64, len(w)))
            n += len(w)
        best: dict[tuple[int, int], tuple] = {}
        for d, s in _suspects(index, docs, threshold):
            here = slice(s * index.width, (s + 2) * index.width)
            terms = np.unique(docs[d][here])
            found = block_max_wand(index, terms[terms >= 0].tolist(), threshold)
            passage = words(texts[start + d])[here] if found else []
            for item, score in found:
                q, a = (_overlap(p, passage) for p in index.parts[item])
                parts = len(index.whole[item]) >= SHINGLE and q >= OVERLAP and a >= OVERLAP
                if parts or _overlap(index.whole[item], passage) >= OVERLAP:
                    best[d, item] = max(best.get((d, item), (0.0,)), (score, q, a))
        for (d, item), got in sorted(best.items()):
            yield start + d, index.ids[item], *got
        start += len(docs)


def _item_words(text: str):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(words)
    return run(text)


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """One index for each part of the benchmark, one after the other, each of a bounded number of words."""
    items = settle(benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
                   .withColumn("w", _item_words("text")).filter(F.size("w") >= SHORTEST))
    whole = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("w")).alias("words")).first()
    if not whole["n"]:
        return
    df = settle(items.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("df")))
    parts = math.ceil(whole["words"] / PART_WORDS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        own = items.filter(part == k)
        held = df.join(own.select(F.explode("w").alias("word")).distinct(), "word", "left_semi")
        rows = own.select("item_id", "text").orderBy("item_id", "text").collect()  # about PART_WORDS words
        index = build([tuple(r) for r in rows], (whole["n"], whole["words"] / whole["n"], {r["word"]: r["df"] for r in held.collect()}))
        if index is not None:
            yield index


MATCH = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item it holds."""
    spark = docs.sparkSession
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            for b in batches:
                got = [(b.column(0)[k].as_py(), *m) for k, *m in search(shared.value, b.column(1).to_pylist(), threshold)]
                cols = list(zip(*got)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        found = docs.select("doc_id", "text").mapInArrow(run, MATCH)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], MATCH)


def _holds(spark, index: Index, threshold: float):
    """Spark function from a text column to whether the text holds an item of `index`."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        hit = np.zeros(len(texts), bool)
        for k, *_ in search(shared.value, texts.tolist(), threshold):
            hit[k] = True
        return pd.Series(hit)
    return run


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without those that hold an item; no text is moved."""
    out = docs
    for index in indexes(benchmark):
        out = out.filter(~_holds(docs.sparkSession, index, threshold)(F.col("text")))
    return out
