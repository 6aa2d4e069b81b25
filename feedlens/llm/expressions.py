"""Expressions that lean toxic: class-conditional Kneser-Ney over words, kept as a table.

Words are runs of letters and digits of any script, lower-cased; in scripts written without blanks each
letter is a word. An expression is a word, or in such scripts also a letter after the letter before it; it
counts once for each labelled document that holds it. The counts are a distributed table that grows with
the corpus. A word's probability in a class backs off to the documents that hold it, pooled over both
classes; that of a letter after another backs off to the letter's. What is left are the expressions whose
toxic log-likelihood exceeds the ordinary one by more than `EXCESS` and which the toxic class has seen
beyond the discount.

Documents are scanned once. A Bloom filter of fixed size passes on the few hashes that may be leaning
expressions; these are joined to the table, so neither the table nor the documents' other words move.

Expressions are known by 64-bit hashes: among 10^10 expressions of a corpus, a document's expression meets
a stranger's hash about once in 10^9.

Pairs of whole words are not counted: they are nearly as many as the words of all texts, and made the
shuffle larger than the input. An expression of several words is known by its words and by the
characters across their blanks.

Edge cases: a null text and one without words have no expressions; a class without rows leaves no leaning
expression; repeated rows count each for itself.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scripts without blanks between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
DISCOUNT = 2
EXCESS = 2.0
#: Words whose hashes a task remembers.
MEMO = 1 << 19

_letter = re.compile(f"[{UNSPACED}]")
_word = re.compile(f"[{UNSPACED}]|[^\\W_{UNSPACED}]+")
_memo: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def _hash(word: str) -> int:
    if word not in _memo:
        if len(_memo) >= MEMO:
            _memo.clear()
        _memo[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return _memo[word]


def keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of each word after the word before it."""
    h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ word
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def expressions(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, before, word) of a text's distinct expressions as signed 64-bit hashes; before is 0 for a word alone."""
    found = words(text)
    h = np.fromiter(map(_hash, found), np.uint64, len(found))
    alone = np.unique(h)
    before, word = h[:0], h[:0]
    if _letter.search(text or ""):
        letter = np.fromiter((_letter.match(w) is not None for w in found), bool, len(found))
        both = letter[:-1] & letter[1:]
        before, word = h[:-1][both], h[1:][both]
    pair, at = np.unique(keys(before, word), return_index=True)
    key = np.concatenate([alone, pair])
    before = np.concatenate([np.zeros(len(alone), np.uint64), before[at]])
    return key.view(np.int64), before.view(np.int64), np.concatenate([alone, word[at]]).view(np.int64)


def leaning(counts: DataFrame) -> DataFrame:
    """(key, pair, ratio) of the expressions that lean toxic, from (key, before, word, ordinary, toxic)."""
    alone, pairs = counts.filter("before = 0"), counts.filter("before != 0")
    total = alone.agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic")],
                      *[F.sum(F.least(c, F.lit(DISCOUNT))).alias(f"cut_{c}") for c in ("ordinary", "toxic")]).first()
    if not total["ordinary"] or not total["toxic"]:
        return counts.select("key", (F.col("before") != 0).alias("pair"), F.lit(0.0).alias("ratio")).filter("false")
    shared = (F.col("ordinary") + F.col("toxic")) / (total["ordinary"] + total["toxic"])

    def smoothed(own, cut, of, shorter):
        return (F.greatest(own - DISCOUNT, F.lit(0)) + cut * shorter) / of

    # an expression within the discount has no toxic mass of its own, and is never one that leans
    seen = F.col("toxic") > DISCOUNT
    one = alone.select("key", "word", "toxic", *[smoothed(F.col(c), F.lit(total[f"cut_{c}"]), F.lit(total[c]), shared)
                                                 .alias(f"p_{c}") for c in ("ordinary", "toxic")])
    few = pairs.filter(seen)
    inside = pairs.join(few.select("before").distinct(), "before", "left_semi").groupBy("before").agg(
        *[F.sum(c).alias(f"all_{c}") for c in ("ordinary", "toxic")],
        *[F.sum(F.least(c, F.lit(DISCOUNT))).alias(f"cut_{c}") for c in ("ordinary", "toxic")])
    two = few.join(inside, "before").join(one.select("word", "p_ordinary", "p_toxic"), "word")
    p = {c: F.when(F.col(f"all_{c}") > 0, smoothed(F.col(c), F.col(f"cut_{c}"), F.col(f"all_{c}"), F.col(f"p_{c}")))
         .otherwise(F.col(f"p_{c}")) for c in ("ordinary", "toxic")}
    ratio = F.round(F.log(p["toxic"] / p["ordinary"]), 6)
    first = F.round(F.log(F.col("p_toxic") / F.col("p_ordinary")), 6)
    return (one.filter(seen).select("key", F.lit(False).alias("pair"), first.alias("ratio"))
            .unionByName(two.select("key", F.lit(True).alias("pair"), ratio.alias("ratio")))
            .filter(F.col("ratio") > EXCESS))


def hits(leads: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Of each `by`: top word, top pair and what words have above EXCESS, from (by, key) rows that may lean.

    Only the distinct rows count, so rows repeating a text are summed once.
    """
    return (leads.distinct().join(table, "key").groupBy(*by)
            .agg(F.max(F.expr("if(pair, 0, ratio)")).alias("top_word"), F.max(F.expr("if(pair, ratio, 0)")).alias("top_pair"),
                 F.sum(F.expr(f"if(pair, 0, cast(ratio - {EXCESS} as decimal(18, 6)))")).cast("double").alias("above")))
