"""Deterministic keys (H1, W7). Built-in sha2 keeps them inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def cache_key(content: Column, provider: Column, model: Column) -> Column:
    """H1: prefix + sha256 hex of ``content:provider:model`` (service parity, see K6/K7)."""
    return F.concat(F.lit(S.CACHE_KEY_PREFIX),
                    F.sha2(F.concat_ws(":", content, provider, model), 256))


def cache_key_v2(*cols: Column) -> Column:
    """Collision-free key: hash of the JSON of every input (fixes K6/K7)."""
    return F.concat(F.lit(S.CACHE_KEY_PREFIX + "v2:"), F.sha2(F.to_json(F.struct(*cols)), 256))


def run_id(request_id: Column, provider: Column, model: Column) -> Column:
    """Stable run id, so a recomputed partition yields the same ids."""
    return F.sha2(F.concat_ws("\u0001", request_id, provider, model), 256)
