"""Order-independent sums of doubles.

A double sum depends on the order partial sums meet, which changes with partitioning; a result
rounded for publication can then flip in its last digit between runs. Summing the values as
decimal(28,10) (38 digits in the sum) is exact and associative; the total is published as double.
Documented precision: each value is first rounded HALF_UP to ten decimals (costs, durations and scores
carry fewer). NaN, infinities and values of 10^18 or more are refused: they count neither in sums nor in
averages, and `refused` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10
DEC = f"decimal(28,{SCALE})"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _exact(c) -> Column:
    return _c(c).try_cast(DEC)


def dsum(c) -> Column:
    return F.sum(_exact(c))


def refused(c) -> Column:
    """How many values no exact sum can hold."""
    return F.count_if(_c(c).isNotNull() & _exact(c).isNull())


def xsum(c) -> Column:
    """Exact sum, as double."""
    return dsum(c).cast("double")


def xavg(c) -> Column:
    """Exact sum divided once by the count of the values in it (null for none)."""
    return F.try_divide(xsum(c), F.count(_exact(c)).cast("double"))


def rsum(c, digits: int = 6) -> Column:
    """Exact sum rounded HALF_UP in decimal, then published as double (no double rounding)."""
    return F.round(dsum(c), digits).cast("double")


def billed_cost() -> Column:
    """K8: a cache hit costs nothing."""
    return F.when(F.col("from_cache"), F.lit(0.0)).otherwise(F.col("cost_usd"))
