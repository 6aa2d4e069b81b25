"""Q9 with indexes: substrings of contents by trigrams, customer ids by deletion neighbourhoods.

A content that holds a text holds all of the text's trigrams, so only rows with all of them are read and verified. A
trigram is stored with lists of the keys that have it, gathered in the tasks that read the contents. Two
ids within two edits of each other become equal when at most two characters are left out of each (an exchanged
character is left out of both), so ids are indexed under all such shortened forms and only ids that share one with
the question are compared. The result is that of the scan (`history.history_search`).

Texts shorter than a trigram, and ids longer than `LONGEST`, are not indexed: the former are searched by scanning,
the latter are always compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDITS, LONGEST = 2, 48
#: Pairs of gram and row that a task gathers before it hands on a list of keys for each gram.
GATHERED = 1 << 20
#: Folders of a stored index, by a hash of the gram; a search reads those of its grams.
SHARDS = 64


def trigrams(text: str) -> list[str]:
    return sorted({text[k:k + 3] for k in range(len(text) - 2)})


def shortened(text: str, edits: int = EDITS) -> set[str]:
    """`text` with up to `edits` characters left out, in every way."""
    out = last = {text}
    for _ in range(edits):
        last = {t[:k] + t[k + 1:] for t in last for k in range(len(t))}
        out = out | last
    return out


def _each(fn):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return F.arrow_udf(run, "array<string>")


def _shard(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHARDS)).cast("int")


def _codes(text: str) -> np.ndarray:
    """`trigrams` as numbers, 21 bits a code point."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    code = np.sort(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])  # np.unique hashes, which takes longer
    return code[_firsts(code)]


def _firsts(code: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array comes first."""
    return np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])


def _gram(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _lists(keys: pa.Array, codes: list[np.ndarray]) -> pa.RecordBatch:
    """(gram, keys) from a key and its trigrams' numbers for each row."""
    code, row = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    starts = _firsts(code)
    ends = pa.array(np.append(starts, len(code)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(map(_gram, code[starts].tolist()), pa.string()),
                                       pa.ListArray.from_arrays(ends, keys.take(pa.array(row)))], names=["gram", "keys"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, codes, held, kind = [], [], 0, None
    for b in batches:
        kind = b.column(0).type
        for key, text in zip(b.column(0), b.column(1)):
            keys.append(key.as_py())
            codes.append(_codes(text.as_py()))
            held += len(codes[-1])
            if held >= GATHERED:
                yield _lists(pa.array(keys, kind), codes)
                keys, codes, held = [], [], 0
    if held:
        yield _lists(pa.array(keys, kind), codes)


def content_index(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(shard, gram, keys): the distinct trigrams of every content, in lower case, each with lists of its rows' keys.

    A gram has a row for each `GATHERED` pairs of a task, so far fewer rows are shuffled and sorted than there are pairs."""
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("keys", T.ArrayType(rows.schema[key].dataType))])
    grams = rows.filter(F.col(content).isNotNull()).select(key, F.lower(content)).mapInArrow(_gather, schema)
    return grams.select(_shard(F.col("gram")).alias("shard"), "gram", "keys")


def id_index(rows: DataFrame, column: str = "customer_id") -> DataFrame:
    """(shard, gram, id): every distinct id, in lower case, under its shortened forms; long ones under null."""
    ids = rows.select(F.lower(column).alias("id")).filter("id is not null").distinct()
    forms = F.when(F.length("id") <= LONGEST, _each(lambda t: sorted(shortened(t)))(
        F.when(F.length("id") <= LONGEST, F.col("id")))).otherwise(F.array(F.lit(None).cast("string")))
    form = ids.select("id", F.explode(forms).alias("gram"))
    shard = F.when(F.col("gram").isNull(), F.lit(-1)).otherwise(_shard(F.col("gram")))
    return form.select(shard.alias("shard"), "gram", "id")


def write(index: DataFrame, path: str) -> None:
    """Store an index by shard, sorted by gram, so that a search reads few row groups of few folders."""
    (index.repartition("shard", F.pmod(F.xxhash64("gram"), F.lit(8))).sortWithinPartitions("shard", "gram")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def _looked_up(index: DataFrame, grams: list[str]) -> DataFrame:
    wanted = index.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select("gram", _shard(F.col("gram")))
    shards = sorted({r[1] for r in wanted.collect()})  # of the question's grams
    return index.filter(F.col("shard").isin(shards) & F.col("gram").isin(grams))


def content_candidates(index: DataFrame, key: str, q: str) -> DataFrame:
    """Keys whose content has all trigrams of `q` (at least three characters)."""
    grams = trigrams(q)
    return (_looked_up(index, grams).select(F.explode("keys").alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == len(grams)).select(key))


def id_candidates(index: DataFrame, customer_q: str) -> DataFrame:
    """Ids that share a shortened form with `customer_q`, and the long ones."""
    near = _looked_up(index, sorted(shortened(customer_q)))
    return near.unionByName(index.filter("shard = -1")).select("id").distinct()


def search(rows: DataFrame, contents: DataFrame, ids: DataFrame, key: str, q: str, customer_q: str | None = None,
           content: str = "content", customer: str = "customer_id", max_edits: int = EDITS) -> DataFrame:
    """Rows whose content holds `q` (in any case) or whose customer id is within `max_edits` of `customer_q`."""
    if max_edits > EDITS:
        raise ValueError(f"ids are indexed for {EDITS} edits")
    spark = rows.sparkSession
    low = spark.range(1).select(F.lower(F.lit(q)).alias("q"), F.lower(F.lit(customer_q)).alias("c")).first()
    holds = F.contains(F.lower(content), F.lit(low["q"]))
    if len(low["q"]) >= 3:
        found = rows.join(content_candidates(contents, key, low["q"]), key, "left_semi").filter(holds)
    else:
        found = rows.filter(holds)
    if customer_q is None:
        return found
    near = id_candidates(ids, low["c"]).filter(F.levenshtein("id", F.lit(low["c"])) <= max_edits)
    by_id = rows.join(near, F.lower(customer) == F.col("id"), "left_semi").filter(~F.coalesce(holds, F.lit(False)))
    return found.unionByName(by_id)
