"""Reuse of column expressions that are built from names alone.

Large expressions (the salvage stages) take thousands of driver to JVM calls to build. They are
unresolved, so one set can serve every DataFrame of the same application. Only functions of plain
strings are cached: two Columns that print alike may be bound to different frames.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def by_name(fn):
    @functools.lru_cache(maxsize=64)
    def built(app: str, *names: str):
        return fn(*names)

    @functools.wraps(fn)
    def wrapper(*names: str):
        if not all(isinstance(n, str) for n in names):
            raise TypeError(f"{fn.__name__} takes column names")
        return built(SparkContext._active_spark_context.applicationId, *names)
    return wrapper
