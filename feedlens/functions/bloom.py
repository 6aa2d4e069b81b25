"""A Bloom filter of key hashes, to thin a large table before it is shuffled.

The filter is built in tasks (each sends its non-empty pieces), added up by Spark, and has a fixed number of
bits whatever the input: with too many keys it lets more rows through, never too few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB: at 10 bits a key, 6.7 million keys with one row in a hundred let through in vain.
BITS, HASHES = 1 << 26, 5
PIECE = 1 << 16  # bytes of a piece


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bits (rows) of each 64-bit hash."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(bits)


def _set_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    field = np.zeros(bits, bool)
    for b in batches:
        field[places(b.column(0).to_numpy(), bits).ravel()] = True
    yield from _pieces({k: v for k, v in enumerate(np.packbits(field).reshape(-1, min(PIECE, bits // 8))) if v.any()})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1)):
            own = np.frombuffer(v.as_buffer(), np.uint8)
            held[k] = held[k] | own if k in held else own.copy()
    yield from _pieces(held)


def _pieces(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()],
                                                                                     pa.binary())], names=["piece", "bits"])


def key_field(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """The filter's bytes for a single column of 64-bit hashes (runs one job over them now)."""
    schema = "piece int, bits binary"
    parts = hashes.mapInArrow(partial(_set_bits, bits=bits), schema).repartition("piece").mapInArrow(_merge, schema)
    field = np.zeros(bits // 8, np.uint8)
    size = min(PIECE, bits // 8)
    for r in parts.collect():  # bits / 8 bytes
        field[r["piece"] * size:(r["piece"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return field


def among(h: np.ndarray, field: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be one of the filter's."""
    at = places(h, len(field) * 8)
    hit = field[(at >> np.uint64(3)).astype(np.int64)] & (128 >> (at & np.uint64(7)).astype(np.uint8))
    return (hit != 0).all(axis=0)


def key_filter(keys: DataFrame, column: str, bits: int = BITS):
    """A function from a column to whether its value may be among `keys`' (runs one job over them now)."""
    hashes = keys.filter(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    shared = keys.sparkSession.sparkContext.broadcast(key_field(hashes, bits))

    def may_contain(c: Column) -> Column:
        def probe(h: pa.Array) -> pa.Array:
            return pa.array(among(h.to_numpy(zero_copy_only=False), shared.value))
        return F.arrow_udf(probe, "boolean")(F.xxhash64(c))
    return may_contain
