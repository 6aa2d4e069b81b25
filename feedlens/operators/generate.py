"""Model-call surface (M1) and attempt bookkeeping (M6, M7, M9).

The model call itself is user code: `fn(pandas.DataFrame) -> pandas.DataFrame` applied per Arrow
batch with mapInPandas. Spark decides where batches run; `parallelism` sets how many calls run
at once. Outputs must be written to a table before reuse (a second action would pay again), and
speculation must stay off for these jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def generate_batch(prompts: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
                   parallelism: int | None = None) -> DataFrame:
    """M1: prompts(run_id, step, provider, model, prompt, ...) → RESPONSE rows."""
    cols = [f.name for f in S.RESPONSE.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = fn(b)
            for c in cols:
                if c not in out.columns:
                    out[c] = None
            yield out[cols]

    src = prompts.repartition(parallelism) if parallelism else prompts
    return src.mapInPandas(run, S.RESPONSE)


def is_retryable(kind_col: str = "error_kind"):
    return ~F.coalesce(F.col(kind_col).isin(*S.NON_RETRYABLE_ERRORS), F.lit(False))


def latest_attempt(attempts: DataFrame, keys=("run_id", "step")) -> DataFrame:
    """M6: best attempt per key – a success wins, then the latest attempt."""
    w = Window.partitionBy(*keys).orderBy(F.col("success").desc(), F.col("attempt").desc())
    return attempts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def retry_select(attempts: DataFrame, max_attempts: int = S.MAX_ATTEMPTS, keys=("run_id", "step")) -> DataFrame:
    """M6: keys whose best attempt failed with a retryable error and has attempts left."""
    best = latest_attempt(attempts, keys)
    return (best.filter(~F.col("success") & is_retryable() & (F.col("attempt") < max_attempts))
            .withColumn("next_attempt", F.col("attempt") + 1))


def wait_seconds(attempt: int) -> int:
    """M6: seconds to wait after a failed attempt: doubling from twice one, 4 at least and 30 at most."""
    return min(S.RETRY_WAIT_MOST, max(S.RETRY_WAIT_LEAST, S.RETRY_WAIT_BASE * 2 ** (attempt - 1)))


def retry_due(attempts: DataFrame, failed_at: str = "failed_at", max_attempts: int = S.MAX_ATTEMPTS,
              keys=("run_id", "step")) -> DataFrame:
    """M6: `retry_select` with `due_at`, before which the next attempt may not start."""
    doubled = F.lit(S.RETRY_WAIT_BASE) * F.pow(F.lit(2), F.least(F.col("attempt"), F.lit(30)) - 1)
    wait = F.least(F.lit(S.RETRY_WAIT_MOST), F.greatest(F.lit(S.RETRY_WAIT_LEAST), doubled)).cast("long")
    return retry_select(attempts, max_attempts, keys).withColumn(
        "due_at", F.timestamp_micros(F.unix_micros(F.col(failed_at).cast("timestamp")) + wait * 1_000_000))


def provider_fallback(attempts: DataFrame, keys=("run_id",)) -> DataFrame:
    """M7: among all providers' attempts, the first success by preference, else the last failure.

    `attempts` has `preference` (1 = primary); ranking is a window per key, no collect.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("success").desc(),
                                          F.when(F.col("success"), F.col("preference")).asc_nulls_last(),
                                          F.col("preference").desc(), F.col("attempt").desc())
    return attempts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def unconfigured(requests: DataFrame, configured: list[str]) -> DataFrame:
    """M9: requests for a provider with no credentials → rejects('provider_not_configured')."""
    known = F.coalesce(F.col("provider").isin(*configured), F.lit(False)) if configured else F.lit(False)
    return (requests.filter(~known)
            .withColumn("reject_reason", F.lit("provider_not_configured")))
