"""Toxicity by class-conditional Kneser-Ney models of characters and of words.

Characters: two models of order `ORDER`, one of toxic and one of ordinary text, counted over all
labelled rows of the fitting folds. Both back off to the same continuation counts of up to `SHARED`
symbols, pooled over the classes, so that a sequence new to both costs them the same there. The
log-likelihood ratio of a character is then one lookup by its n-gram. Ratios are summed over words and
averaged over the text. Text is lower-cased; a-z, blank, digit, punctuation and three kinds of non-ASCII
byte make 32 symbols, so this model is a table of at most 32^ORDER n-grams (4 MB for order 4) that
reads new forms of known stems.

Words: what the corpus tells of single expressions, in any script, is a distributed table of counts of
words and pairs of words that grows with the corpus (`expressions`); the documents' few expressions
that may lean toxic are joined to it. A logistic curve over the scores of both, fitted on another fold,
turns them into a probability; each row teaches it twice, once as if its expressions were new, so that what
the words tell does not outweigh forms that only the characters know. A score is a function of the text,
and is carried by two hashes of it.

Edge cases: null and empty texts score as a text without words; a label that is null counts as no
label, a doc_id with several labels as toxic if any is; without labels of both classes every score
is 0; an empty table gives no rows; repeated rows score alike; extra columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import among, key_field, key_filter
from . import expressions
from .common import fold, settle

ORDER, SHARED = 4, 2
DISCOUNT = 0.75
FOLDS, HELD, FIT, TUNE = 4, 2, (0, 1), 3
#: The logistic curve is fitted on at most so many labelled rows, the first by a hash of their id.
TUNE_ROWS = 20_000
#: Symbols counted at once in a task.
CHUNK = 2_000_000
BLANK, DIGIT, MARK = 0, 27, 31
EXCESS = 2.0
#: Scales that bring the scores to about one, and the curve used when the tuning fold lacks a class.
SCALE = np.array([0.5, 2.0, 10.0, 10.0, 10.0, 4.0, 4.0, 1.0])
PLAIN = np.array([0.0, 0.0, 2.0, 6.0, 0.0, 1.0, 1.0, 0.0, -8.0])
#: The first of them are the character model's.
CHARACTERS = 5
COUNTS = "kind int, key long, before long, word long, toxic int, n long"
BY_CHARACTER, BY_WORD = 0, 1


def _symbol_table() -> np.ndarray:
    table = np.full(256, MARK, np.uint8)
    table[[32, 9, 10, 11, 12, 13]] = BLANK
    table[ord("0"):ord("9") + 1] = DIGIT
    table[ord("a"):ord("z") + 1] = np.arange(1, 27)
    table[128:192] = 28 + np.arange(64) % 2  # continuation bytes, two kinds
    table[192:] = 30  # lead bytes
    return table


_SYMBOLS = _symbol_table()


def symbols(text: str | None) -> np.ndarray:
    """A text's symbols between blanks, after ORDER - 1 blanks of context."""
    raw = f"{' ' * ORDER}{(text or '').lower()} ".encode()
    return _SYMBOLS[np.frombuffer(raw, np.uint8)]


def grams(s: np.ndarray) -> np.ndarray:
    """The n-gram ending at each symbol from the ORDER-th, five bits a symbol."""
    n = len(s) - ORDER + 1
    code = np.zeros(n, np.int32)
    for k in range(ORDER):
        code = (code << 5) | s[k:k + n]
    return code


def _batch(kind: int, toxic: int, key: np.ndarray, before: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    same = np.ones(len(key), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (same * kind, key, before, word, same * toxic, n)],
                                      names=["kind", "key", "before", "word", "toxic", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to counts of character n-grams, one set for each task, and of documents by expression,
    added up every CHUNK."""
    total = np.zeros((2, 1 << 5 * ORDER), np.int64)
    grams_held, expressions_held = ([], []), ([], [])

    def drained(k: int) -> Iterator[pa.RecordBatch]:
        if grams_held[k]:
            total[k] += np.bincount(np.concatenate(grams_held[k]), minlength=total.shape[1])
            parts = np.concatenate(expressions_held[k], axis=1)
            key, at, n = np.unique(parts[0], return_index=True, return_counts=True)
            yield _batch(BY_WORD, k, key, parts[1, at], parts[2, at], n)
            grams_held[k].clear()
            expressions_held[k].clear()

    held = [0, 0]
    for b in batches:
        for text, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            grams_held[k].append(grams(symbols(text)))
            expressions_held[k].append(np.stack(expressions.expressions(text)))
            held[k] += len(grams_held[k][-1])
            if held[k] > CHUNK:
                held[k] = 0
                yield from drained(k)
    for k in (0, 1):
        yield from drained(k)
        code = np.flatnonzero(total[k])
        yield _batch(BY_CHARACTER, k, code, np.zeros_like(code), code, total[k, code])


def _labels(labels: DataFrame) -> DataFrame:
    return labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, key, before, word, ordinary, toxic) over all labelled rows of the fitting folds."""
    chosen = fold(F.col("doc_id"), FOLDS).isin(*FIT)
    # labels grow with the corpus: the same join at every size, which spills
    known = _labels(labels).filter(chosen).hint("merge")
    rows = docs.filter(chosen).select("doc_id", "text").join(known, "doc_id")
    counted = rows.select("text", F.col("toxic").cast("int")).mapInArrow(_counted, COUNTS)
    return counted.groupBy("kind", "key", "before", "word").agg(
        F.sum(F.expr("if(toxic = 0, n, 0)")).alias("ordinary"), F.sum(F.expr("if(toxic = 1, n, 0)")).alias("toxic"))


def _types(seen: np.ndarray) -> np.ndarray:
    """How many of the n-grams seen end in each (n-1)-gram."""
    return seen.reshape(32, -1).sum(axis=0).astype(float)


def _probability(levels: list[np.ndarray]) -> np.ndarray:
    """Interpolated Kneser-Ney: of each n-gram of the last level, its last symbol given the others.

    `levels[n - 1]` counts all 32^n n-grams, below the last level by their continuations. A context
    that was never seen leaves it to the shorter one.
    """
    p = 0.99 * levels[0] / max(1.0, levels[0].sum()) + 0.01 / 32
    for n, count in enumerate(levels[1:], 2):
        count = count.reshape(-1, 32)
        total, kinds = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(p.reshape(-1, 32), (32, 1)) if n > 2 else np.tile(p, (32, 1))
        own = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * shorter) / np.maximum(total, 1)
        p = np.where(total > 0, own, shorter).reshape(-1)
    return p


def ratios(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """log p(toxic) - log p(ordinary) of every n-gram, from the counts of all 32^ORDER n-grams.

    Levels of up to SHARED symbols pool the continuations of both classes, longer ones are the class's.
    """
    def chain(count: np.ndarray) -> list[np.ndarray]:
        levels = [count.astype(float)]
        while len(levels[0]) > 32:
            levels.insert(0, _types(levels[0] > 0))
        return levels

    both = chain(ordinary + toxic)
    logs = [np.log(_probability(both[:SHARED] + chain(n)[SHARED:])) for n in (ordinary, toxic)]
    return (logs[1] - logs[0]).astype(np.float32)


@dataclass
class Model:
    """ratio: log-likelihood ratio by character n-gram; leaning: the table of expressions; field: the Bloom
    filter of its keys; curve: weights of the scores, the intercept last."""
    ratio: np.ndarray
    leaning: DataFrame
    field: np.ndarray
    curve: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of rows of scores."""
        z = x / SCALE @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(text: str | None, ratio: np.ndarray) -> np.ndarray:
    """By characters: length-normalised ratio of the text and of its best word, the two best words' sums, and what all
    words have above `EXCESS`, over the root of their number."""
    s = symbols(text)
    r = ratio[grams(s)]
    run = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
    blanks = np.flatnonzero(s[ORDER - 1:] == BLANK)
    long = np.diff(blanks)
    word = (run[blanks[1:] + 1] - run[blanks[:-1] + 1])[long > 1]  # with the blank after it
    if not len(word):
        return np.zeros(CHARACTERS)
    top = np.sort(np.partition(word, max(0, len(word) - 2))[-2:])
    return np.array([run[-1] / len(r), (word / long[long > 1]).max(), top[-1], top[0] if len(word) > 1 else 0.0,
                     np.maximum(word - EXCESS, 0).sum() / np.sqrt(len(word))])


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept.

    Each row counts once as it is and once without its scores by words.
    """
    new = x * (np.arange(x.shape[1]) < CHARACTERS)
    x, y = np.concatenate([x, new]), np.concatenate([y, y])
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + pull
        w = w - np.linalg.solve(h, x.T @ (p - y) + pull @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Count, smooth and tune; None if the fitting folds lack a class."""
    counted = settle(counts(docs, labels))
    got = counted.filter(F.col("kind") == BY_CHARACTER).select("key", "ordinary", "toxic").toPandas()  # 32^ORDER rows
    if not len(got) or not got["ordinary"].any() or not got["toxic"].any():
        return None
    dense = np.zeros((2, 1 << 5 * ORDER))
    dense[:, got["key"]] = got["ordinary"], got["toxic"]
    leaning = settle(expressions.leaning(counted.filter(F.col("kind") == BY_WORD).drop("kind")))
    model = Model(ratios(*dense), leaning, key_field(leaning.select("key")), PLAIN)
    chosen = fold(F.col("doc_id"), FOLDS) == TUNE
    known = _labels(labels).filter(chosen).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TUNE_ROWS)
    # of rows repeating an id, the one whose text hashes lowest: TUNE_ROWS at most
    rows = (docs.filter(chosen).select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic")
            .agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("one")).select("toxic", "one.text"))
    tune = features(rows, model, ["toxic"]).toPandas()
    y = tune["toxic"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        model.curve = _curve(np.stack(tune["x"].to_numpy()) / SCALE, y)
    return model


def _text_hashes() -> list:
    return [F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")]


def _scan(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep`, the text's hashes, its scores by characters, its words and the expressions that may lean."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.field))
    kind = pa.struct([("x", pa.list_(pa.float64())), ("words", pa.int64()), ("leads", pa.list_(pa.int64()))])

    def read(texts: pa.Array) -> pa.Array:
        ratio, field = shared.value
        out = []
        for t in texts.to_pylist():
            key, before, _ = expressions.expressions(t)
            out.append({"x": scores(t, ratio), "words": int((before == 0).sum()), "leads": key[among(key, field)]})
        return pa.array(out, kind)
    read = F.arrow_udf(read, "struct<x: array<double>, words: long, leads: array<long>>")
    first, second = _text_hashes()
    return (docs.select(*[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)], first.alias("_h1"),
                        second.alias("_h2"), read("text").alias("_read"))
            .select(*[f"_keep{k}" for k in range(len(keep))], "_h1", "_h2", "_read.*"))


def features(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` and x, the scores of each row's text by characters and by words.

    What the scan leaves of a document is settled (some 100 bytes); only rows with expressions that may
    lean are joined to what the table says of them.
    """
    rows = settle(_scan(docs, model, keep))
    by = ["_h1", "_h2"]
    some = F.size("leads") > 0
    found = expressions.hits(rows.filter(some).select(*by, F.explode("leads").alias("key")), model.leaning, by)
    joined = rows.filter(some).join(found, by, "left")
    words = [F.coalesce("top_word", F.lit(0.0)), F.coalesce("top_pair", F.lit(0.0)),
             F.coalesce("above", F.lit(0.0)) / F.sqrt("words")]
    kept = [F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)]
    return (joined.select(*kept, F.concat("x", F.array(*words)).alias("x"))
            .unionByName(rows.filter(~some).select(*kept, F.concat("x", F.array(*[F.lit(0.0)] * len(words))).alias("x"))))


def with_score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """`keep` of `docs`, and score, the probability of being toxic."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    z = F.lit(float(model.curve[-1]))
    for k, w in enumerate(model.curve[:-1] / SCALE):
        z = z + F.col("_x")[k] * float(w)
    # "x" is added last, so that a kept column of that name does not clash
    rows = features(docs, model, keep).toDF(*[f"_keep{k}" for k in range(len(keep))], "_x")
    return rows.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)],
                       (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return (with_score(docs, fit(docs, labels), ["doc_id"])
            .select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """`docs` without those whose score reaches the threshold.

    A Bloom filter of the rejected texts' hashes lets clean texts through where they are read; only the
    texts that it holds are shuffled, to be compared with the rejected ones.
    """
    model = fit(docs, labels)
    if model is None:
        return docs
    first, second = _text_hashes()
    hashed = docs.select("text", first.alias("_h1"), second.alias("_h2"))
    rejected = settle(with_score(hashed, model, ["_h1", "_h2"]).filter(F.col("score") >= threshold)
                      .select("_h1", "_h2").distinct())
    suspected = key_filter(rejected, "_h1")(F.xxhash64("text"))
    again = docs.filter(suspected)
    kept = again.join(rejected, (F.xxhash64(again["text"]) == rejected["_h1"])
                      & (F.xxhash64(F.lit("second"), again["text"]) == rejected["_h2"]), "left_anti")
    return docs.filter(~suspected).unionByName(kept)
