"""Language identification by compression: the language whose dictionary packs the text smallest.

For each language a raw-content zstandard dictionary is made of short pieces of many training texts
(the first `PIECES` by a hash of the id, each cut at a hashed place, so that no single text or shared
passage dominates; that is the bounded sample the method learns from). A text is lower-cased, all but
letters become blanks, and its blocks are compressed with every dictionary; the smallest total wins.
Close results are marked `rejected`: their language is still the smallest, but the margin is narrow.

Edge cases: a null text, or one without a letter, is `und` with score 0; rows with a null text or lang
teach nothing; ties go to the first language by code point; without training rows all is `und`; an
empty table gives no rows; repeated rows get the same answer; extra columns are kept by `identify`.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, join_summary, settle

PIECES, PIECE, SPARE = 1024, 128, 2
LEVEL, BLOCK = 9, 4096
#: Rejected: the second language's total is less than this share above the first's.
MARGIN = 0.01
FOLDS, HELD = 5, 0
UNKNOWN = "und"

_no_letters = re.compile(r"[\W\d_]+")


def prepared(text: str | None) -> bytes:
    """The letters of a text, lower-cased, with single blanks between; empty if it has none."""
    plain = _no_letters.sub(" ", (text or "").lower())
    return plain.encode() if any(map(str.isalpha, plain)) else b""


class Model:
    """Dictionaries by language; compressors are made where they are used."""

    def __init__(self, pieces: dict[str, bytes]):
        self.pieces = dict(sorted(pieces.items()))

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces}

    @cached_property
    def compressors(self) -> list:
        out = []
        for raw in self.pieces.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False,
                                                write_checksum=False, write_dict_id=False))
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        raw = prepared(text)
        if not raw or not self.pieces:
            return UNKNOWN, 0.0, True
        blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
        size = np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors], float)
        best = int(size.argmin())  # the first of equals
        share = 1 / np.exp((size[best] - size) / (1 + 0.01 * size[best])).sum()
        others = np.delete(size, best)
        narrow = bool(len(others)) and others.min() - size[best] < MARGIN * others.min()
        return list(self.pieces)[best], float(share), bool(narrow)


def fit(docs: DataFrame) -> Model:
    """Collects at most PIECES pieces of PIECE characters for each language.

    A language's rows are first thinned, by the hash of their id, to about SPARE times as many as are
    needed (by its count), so that no task ranks all rows of a frequent language.
    """
    taught = fold(F.col("doc_id"), FOLDS) != HELD
    counts = settle(docs.filter(F.col("lang").isNotNull() & taught).groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.length("text") - PIECE, F.lit(1)))
    rows = (docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & taught)
            .select("lang", F.xxhash64(F.lit("piece"), "doc_id").alias("rank"),
                    F.substring("text", (place + 1).cast("int"), F.lit(PIECE)).alias("piece")))
    share = F.pmod("rank", F.lit(1_000_000)) / 1_000_000
    rows = join_summary(rows, counts, ["lang"]).filter(share * F.col("n") < SPARE * PIECES)
    first = Window.partitionBy("lang").orderBy("rank", "piece")
    got = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= PIECES).collect()
    by: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["nth"])):
        by.setdefault(r["lang"], []).append(prepared(r["piece"]))
    return Model({k: b" ".join(v) for k, v in by.items() if any(v)})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and rejected (columns of these names are replaced)."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(F.struct(*kept).alias("_row"), run("text").alias("_lang")).select("_row.*", "_lang.*")


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred",
                        "score", "rejected")
