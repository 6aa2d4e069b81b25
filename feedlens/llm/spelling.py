"""Spelling variants: near words by an index of variable-length grams, and the common form that each leads to.

Two words are near if one inserted, deleted or replaced code point turns one into the other.

1. Words are counted in tasks and added up by Spark.
2. The gram dictionary: all pairs of neighbouring code points of the words (with a mark at either end), and longer
   grams, up to `LONGEST`, where the gram without its last code point occurs more than `OFTEN` times; the commonest
   `GRAMS` of them. It steers the work only: the result is exact with any dictionary.
3. A word is decomposed into the longest dictionary gram at each place. An edit at place i can only change the grams
   that reach over i, or whose text up to i begins a longer dictionary gram. The largest number of such grams over
   all i is the word's affected-gram bound: near words share all others, at the same place or, behind the edit, one
   place on.
4. Lists are merged by that bound: of g grams of which at most a are affected, in the order of their counts, two near
   words share one of the first a + 1 of each. Lists hold one gram at one place of words of one length; words of the
   next shorter length look there too.
5. Words that meet in a list are verified by their edit distance, in tasks that read sorted lists; very long lists
   are joined instead, so that Spark can split them.

Edge cases: null and empty texts have no words; a null doc_id counts as empty text before the colon; repeated rows
count again; an empty table gives no rows; extra columns are ignored; ties of the commonest near word go to the
smallest in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shuffle_width

SHORTEST, LONGEST, OFTEN, GRAMS = 2, 5, 200, 1 << 18
#: Distinct words that a task holds before it hands its counts on.
HELD = 200_000
#: Words of a list that one task compares, code points of a word there, pairs compared at once.
LIST, WIDE, CHUNK = 1024, 64, 1 << 18
FIRST, LAST = "^", "$"  # no letters, so no word holds them


def observed(doc_id, text: str | None, least: int = 1, every: int = 31) -> Counter:
    """The words of one text from runs of `least` code points on, lower-cased A-Z; where `every` divides a word's
    hash, one code point is left out."""
    out: Counter = Counter()
    if not text:
        return out
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    low = text.encode().lower().decode()  # of bytes only A-Z change
    for word, n in Counter(re.findall(f"[A-Za-zÀ-ÿ]{{{least},}}", low)).items():
        h = zlib.crc32(word.encode(), start)
        if h % every == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1:]
        out[word] += n
    return out


def _counts(total: Counter, name: str) -> pa.RecordBatch:
    """What a task has counted, which is then forgotten."""
    out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                     names=[name, "n"])
    total.clear()
    return out


def words(docs: DataFrame, least: int = 7, often: int = 2) -> DataFrame:
    """word and n of every word of at least `least` code points and `often` occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for word, n in observed(doc_id, text.as_py(), least).items():
                    if len(word) >= least:
                        total[word] += n
                if len(total) >= HELD:
                    yield _counts(total, "word")
        yield _counts(total, "word")
    return (docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often))


def dictionary(vocabulary: DataFrame, longest: int = LONGEST, often: int = OFTEN, most: int = GRAMS) -> dict[str, int]:
    """The frequency-pruned grams with their counts over the distinct words; at most `most`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for word in b.column(0).to_pylist():
                s = FIRST + word + LAST
                for q in range(SHORTEST, longest + 1):
                    total.update([s[p:p + q] for p in range(len(s) - q + 1)])
                if len(total) >= HELD:
                    yield _counts(total, "gram")
        yield _counts(total, "gram")
    n = shuffle_width(vocabulary.sparkSession)
    shares = vocabulary.select("word").repartition(n, "word").mapInArrow(run, "gram string, n long")
    counts = settle(shares.groupBy("gram").agg(F.sum("n").alias("n")))
    stems = counts.filter(F.col("n") > often).select(F.col("gram").alias("stem"))
    stem = F.expr("substring(gram, 1, length(gram) - 1)")
    longer = counts.filter(F.length("gram") > SHORTEST).join(stems, stem == F.col("stem"), "left_semi")
    kept = counts.filter(F.length("gram") == SHORTEST).unionByName(longer)
    return {r["gram"]: r["n"] for r in kept.orderBy(F.desc("n"), "gram").limit(most).collect()}  # `most` rows


class Grams:
    """Decomposes words by a gram dictionary."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.longest = max(map(len, counts), default=SHORTEST)
        self.stems = {g[:k] for g in counts for k in range(1, len(g))}

    def decompose(self, word: str) -> tuple[list[tuple[int, str, int]], int]:
        """[(count, gram, place)] of a word and the most of them that one edit can change."""
        s = FIRST + word + LAST
        n = len(s) - 1
        grams, steps = [], [0] * (n + 2)
        for p in range(n):
            length = min(self.longest, len(s) - p)
            while length > SHORTEST and s[p:p + length] not in self.counts:
                length -= 1
            gram = s[p:p + length]
            grams.append((self.counts.get(gram, 0), gram, p))
            reach = min(self.longest - 1, len(s) - p)  # the longest text from p that begins a longer gram
            while reach >= length and s[p:p + reach] not in self.stems:
                reach -= 1
            steps[max(p, 1)] += 1  # an edit at place i, from 1 to n, changes it while p <= i <= p + max(...)
            steps[min(p + max(length - 1, reach), n) + 1] -= 1
        worst = here = 0
        for i in range(1, n + 1):
            here += steps[i]
            worst = max(worst, here)
        return grams, worst

    def leading(self, word: str) -> list[tuple[str, int]]:
        """The (gram, place) of a word of which any near word has one among its own, the rarest first."""
        grams, worst = self.decompose(word)
        return [(g, p) for _, g, p in sorted(grams)[:worst + 1]]


def _lists(vocabulary: DataFrame, counts: dict[str, int]) -> DataFrame:
    """key of a list and a word in it; `own` tells words of the list's length from those one shorter."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(counts)  # at most GRAMS short texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(sent.value)
        for b in batches:
            keys, own, of = [], [], []
            for k, word in enumerate(b.column(0).to_pylist()):
                size = len(word)
                for g, p in grams.leading(word):
                    for length, place in ((size, p), (size + 1, p), (size + 1, p + 1)):
                        keys.append(xxhash.xxh64_intdigest(f"{g} {length} {place}") - (1 << 63))
                        own.append(length == size)
                        of.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.bool_()),
                                              b.column(0).take(pa.array(of, pa.int32()))], names=["key", "own", "word"])
    n = shuffle_width(vocabulary.sparkSession)
    return vocabulary.select("word").repartition(n, "word").mapInArrow(run, "key long, own boolean, word string")


def _pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, of rows that lie in runs of the given sizes, one run after the other."""
    start = np.repeat(np.cumsum(size) - size, size)
    end = np.repeat(np.cumsum(size), size)
    row = np.arange(len(start))
    after = end - row - 1
    i = np.repeat(row, after)
    j = np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after) + i + 1
    return i, j


def _one_edit(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rows of `a` are one edit from those of `b` (bytes, filled up with zeros, one column to spare).

    `longer` tells rows of `b` that are one code point longer; the others are of one length.
    """
    off = a != b
    out = off.sum(axis=1) == 1
    k = np.flatnonzero(longer)
    first = off[k].argmax(axis=1)  # up to here they agree, and behind it b is one place on
    moved = a[k, :-1] != b[k, 1:]
    last = np.where(moved.any(axis=1), moved.shape[1] - 1 - moved[:, ::-1].argmax(axis=1), -1)
    out[k] = last < first
    return out


def _meet(batches: Iterator[pa.RecordBatch], most: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to near pairs (word, other), found by comparing the words of each list.

    Rows of lists beyond `most` words, and words beyond `wide` code points, are handed on with their key.
    """
    names = ["word", "other", "key", "own"]

    def found(words: np.ndarray, own: np.ndarray, size: np.ndarray):
        width = max(map(len, words)) + 1
        codes = np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8)
        codes, length = codes.reshape(-1, width), np.fromiter(map(len, words), np.int64, len(words))
        i, j = _pairs(size)
        use = own[i] | own[j]
        i, j = i[use], j[use]
        swap = length[i] > length[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        near = _one_edit(codes[i], codes[j], length[j] > length[i])
        p, q = i[near], j[near]
        none = pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(words[p], pa.string()), pa.array(words[q], pa.string()), *none],
                                          names=names)

    def handed_on(key: np.ndarray, own: np.ndarray, words: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.nulls(len(words), pa.string()),
                                           pa.array(key), pa.array(own)], names=names)

    def lists(key, own, words):
        """Pairs and rows of whole lists."""
        long = np.fromiter(map(len, words), np.int64, len(words)) > wide
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        size = np.bincount(group)
        apart = ((size > most) | (np.bincount(group, long) > 0))[group]
        if apart.any():
            yield handed_on(key[apart], own[apart], words[apart])
        keep = ~apart & ((size > 1) & (np.bincount(group, own) > 0))[group]
        key, own, words, group = key[keep], own[keep], words[keep], group[keep]
        size = size[np.unique(group)]
        # lists of about CHUNK pairs together, a larger one alone
        turn = np.cumsum(size * (size - 1) // 2) // CHUNK
        ends = np.append(0, np.cumsum(size))
        cuts = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(size)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                rows = slice(ends[a], ends[z])
                yield found(words[rows], own[rows], size[a:z])

    carry, beyond = None, None  # the last list so far; the key of one that is too large and already handed on
    for b in batches:
        key = b.column(0).to_numpy()
        own = b.column(1).to_numpy(zero_copy_only=False)
        words = b.column(2).to_numpy(zero_copy_only=False)
        if carry is not None:
            key, own, words = (np.concatenate(x) for x in zip(carry, (key, own, words)))
        if beyond is not None and len(key):
            rest = key == beyond
            if rest.any():
                yield handed_on(key[rest], own[rest], words[rest])
                key, own, words = key[~rest], own[~rest], words[~rest]
        if not len(key):
            carry = None
            continue
        last = key == key[-1]
        if last.sum() > most:
            beyond = key[-1]
            yield handed_on(key[last], own[last], words[last])
            carry = None
        else:
            beyond = None if beyond is not None and key[-1] != beyond else beyond
            carry = key[last], own[last], words[last]
        if not last.all():
            yield from lists(key[~last], own[~last], words[~last])
    if carry is not None and len(carry[0]):
        yield from lists(*carry)


def near(vocabulary: DataFrame, counts: dict[str, int], most: int = LIST, wide: int = WIDE) -> DataFrame:
    """(word, other) of every two near words, both ways."""
    n = shuffle_width(vocabulary.sparkSession)
    lists = _lists(vocabulary, counts).repartition(n, "key").sortWithinPartitions("key")
    met = settle(lists.mapInArrow(partial(_meet, most=most, wide=wide),
                                  "word string, other string, key long, own boolean"))
    # lists that no task should compare alone are joined; Spark splits their keys
    apart = met.filter("key is not null").select("word", "key", "own")
    own = apart.filter("own").select("key", F.col("word").alias("other"))
    joined = (apart.join(own, "key").filter("not own or word < other")
              .filter("levenshtein(word, other, 1) = 1").select("word", "other"))
    pairs = met.filter("key is null").select("word", "other").unionByName(joined)
    both = pairs.select(F.explode(F.array(F.struct("word", "other"), F.struct(
        F.col("other").alias("word"), F.col("word").alias("other")))).alias("p")).select("p.*")
    return both.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: forms followed to the last, twice as far each round.

    A form occurs at least `times` as often as its word, so chains are short.
    """
    at = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = settle(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                       F.col("next").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, least: int = 7, times: int = 10, longest: int = LONGEST, often: int = OFTEN,
             most: int = GRAMS, lists: int = LIST) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word (see the module).

    A word of c code points has c + 1 grams, of which an edit changes `longest` at most, so near words share one
    as long as no gram is longer than the shortest word.
    """
    if longest > least:
        raise ValueError("grams may not be longer than the shortest word")
    vocabulary = settle(words(docs, least))
    counted = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    around = near(vocabulary, dictionary(vocabulary, longest, often, most), lists).join(counted, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    out = settle(vocabulary.join(around, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"),
        F.when(fits, -F.col("best.less")).alias("form_n")))
    roots = _roots(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                                                  "form_n")
