"""Run-history dashboards and provider comparison (Q1–Q17) over a `runs` table.

`runs` columns: run_id, started_at, user_id, customer_id, source, provider, model, success,
from_cache, duration_s, cost_usd, accuracy, risk. Period bounds are job parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import billed_cost, rsum, xavg

PROVIDER_ORDER = ["openai", "anthropic", "google"]


def _between(df: DataFrame, start, end, col: str = "started_at") -> DataFrame:
    return df.filter((F.col(col) >= F.lit(start).cast("timestamp")) & (F.col(col) < F.lit(end).cast("timestamp")))


def summary(runs: DataFrame, start, end) -> DataFrame:
    """Q1."""
    r = _between(runs, start, end)
    return r.agg(F.count(F.lit(1)).alias("total_runs"), rsum(billed_cost()).alias("total_cost_usd"),
                 xavg("duration_s").alias("avg_latency_s"),
                 F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
                 F.round(F.avg(F.col("from_cache").cast("double")), 6).alias("cache_hit_rate"))


def cost_by_provider(runs: DataFrame) -> DataFrame:
    """Q2."""
    return runs.groupBy("provider").agg(rsum(billed_cost()).alias("cost_usd"),
                                        F.count(F.lit(1)).alias("runs"))


def by_day(runs: DataFrame) -> DataFrame:
    """Q3: runs, latency and cost per day."""
    return runs.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), xavg("duration_s").alias("avg_latency_s"),
        rsum(billed_cost()).alias("cost_usd"))


def period_delta(runs: DataFrame, start, end, prev_start) -> DataFrame:
    """Q4: current period vs the previous one, in one pass with conditional sums."""
    r = _between(runs, prev_start, end)
    cur = F.col("started_at") >= F.lit(start).cast("timestamp")
    a = r.agg(F.sum(cur.cast("long")).alias("current_runs"), F.sum((~cur).cast("long")).alias("previous_runs"),
              rsum(F.when(cur, billed_cost()).otherwise(0.0)).alias("cc"),
              rsum(F.when(~cur, billed_cost()).otherwise(0.0)).alias("pc"))
    return a.select("current_runs", "previous_runs",
                    F.round((F.col("current_runs") - F.col("previous_runs")) * 100.0 / F.col("previous_runs"), 6)
                    .alias("runs_change_pct"),
                    F.col("cc").alias("current_cost_usd"), F.col("pc").alias("previous_cost_usd"))


def quality_avg(runs: DataFrame) -> DataFrame:
    """Q5 (K5: failed runs carry placeholder scores, so only successes count)."""
    return runs.filter("success").groupBy("provider").agg(xavg("accuracy").alias("avg_accuracy"),
                                                          xavg("risk").alias("avg_risk"))


def latency_hist(runs: DataFrame, width: float = 5.0) -> DataFrame:
    """Q6."""
    b = (F.floor(F.col("duration_s") / width) * width).alias("bucket_s")
    return runs.groupBy(b).agg(F.count(F.lit(1)).alias("n"))


def history_filter(runs: DataFrame, start, end, provider=None, success=None, source=None) -> DataFrame:
    """Q7: simple predicates only, so Catalyst pushes them into the scan."""
    r = _between(runs, start, end)
    if provider is not None:
        r = r.filter(F.col("provider") == provider)
    if success is not None:
        r = r.filter(F.col("success") == F.lit(success))
    if source is not None:
        r = r.filter(F.col("source") == source)
    return r


def history_page(runs: DataFrame, sort_col: str, page: int, size: int = 20, descending: bool = True,
                 after: tuple | None = None) -> DataFrame:
    """Q8: one page in (sort, run_id) order – a top-(page·size) sort, then the offset.

    For deep pages give `after`, the (sort value, run_id) of the last row seen: the page is then the
    first `size` rows beyond it, found with a filter and a top-`size` sort, and `page` is not used.
    """
    order = [F.col(sort_col).desc() if descending else F.col(sort_col).asc(), F.col("run_id").asc()]
    if after is None:
        rows = runs.orderBy(*order).offset((page - 1) * size).limit(size)
    else:
        value, run_id = (F.lit(x) for x in after)
        beyond = F.col(sort_col) < value if descending else F.col(sort_col) > value
        rows = runs.filter(beyond | ((F.col(sort_col) == value) & (F.col("run_id") > run_id))).orderBy(*order).limit(size)
    # the total is a scalar subquery: computed once, no join
    total = runs.agg(F.count(F.lit(1))).scalar()
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / size))


def history_search(feedback: DataFrame, q: str, customer_q: str | None = None, max_edits: int = 2) -> DataFrame:
    """Q9: substring search in content (the text is taken literally, in any case); `fuzzy` on customer
    ids by edit distance."""
    cond = F.contains(F.lower("content"), F.lower(F.lit(q)))
    if customer_q is not None:
        cond = cond | (F.levenshtein(F.lower("customer_id"), F.lit(customer_q.lower())) <= max_edits)
    return feedback.filter(cond)


def history_delete(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Q10: delete = anti join against the id list, then rewrite the table."""
    return runs.join(ids.select("run_id"), "run_id", "left_anti")


def recent_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    """Q11: top-k by time (TakeOrderedAndProject)."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").asc()).limit(k)


def _scored():
    """K5: a failed run carries placeholder scores, so it has no accuracy."""
    return F.when(F.col("success"), F.col("accuracy"))


def provider_stats(runs: DataFrame, key: str = "input_key") -> DataFrame:
    """Averages per input and provider, with billed costs (K8) and scores of successes (K5)."""
    return runs.groupBy(key, "provider").agg(xavg("duration_s").alias("latency_s"),
                                              xavg(billed_cost()).alias("cost_usd"),
                                              xavg(_scored()).alias("accuracy"))


def compare_pivot(runs: DataFrame, key: str = "input_key") -> DataFrame:
    """Q12: providers side by side on the same input (pivot values given, so no extra distinct pass)."""
    p = runs.groupBy(key).pivot("provider", PROVIDER_ORDER).agg(
        xavg("duration_s").alias("latency_s"), xavg(billed_cost()).alias("cost_usd"),
        xavg(_scored()).alias("accuracy"))
    return p


def compare_winner(runs: DataFrame, key: str = "input_key") -> DataFrame:
    """Q13: best accuracy per dollar (ours), ties by provider name; without costs there is no score."""
    s = provider_stats(runs, key).withColumn("score", F.try_divide("accuracy", "cost_usd"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("provider").asc())
    return (s.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select(key, "provider", "score"))


def compare_cost_diff(runs: DataFrame, key: str = "input_key") -> DataFrame:
    """Q14: % above the cheapest provider for the same input (null where that costs nothing)."""
    s = provider_stats(runs, key)
    cheapest = F.min("cost_usd").over(Window.partitionBy(key))
    return s.select(key, "provider", "cost_usd",
                    F.try_divide((F.col("cost_usd") - cheapest) * 100, cheapest).alias("pct_over_cheapest"))


def quality_band(runs: DataFrame) -> DataFrame:
    """Q15: green > 90 %, yellow 80–90 %, red < 80 %."""
    a = F.col("accuracy")
    return runs.select("run_id", F.when(a > 0.9, "green").when(a >= 0.8, "yellow").otherwise("red").alias("band"))


def route_cheapest(runs: DataFrame, sla_p95_s: float) -> DataFrame:
    """Q16: the cheapest provider whose p95 latency meets the SLA."""
    from .metrics import exact_percentiles
    p95 = exact_percentiles(runs, ["provider"], "duration_s", [0.95]).select("provider", F.col("value").alias("p95_s"))
    cost = runs.groupBy("provider").agg(xavg(billed_cost()).alias("avg_cost"))
    ok = p95.join(cost, "provider").filter(F.col("p95_s") <= sla_p95_s)
    return ok.agg(F.min_by("provider", F.struct("avg_cost", "provider")).alias("provider"),
                  F.min("avg_cost").alias("avg_cost_usd"))


def retry_failed(runs: DataFrame, key=("user_id", "source")) -> DataFrame:
    """Q17: failed runs with no later success for the same key (one row per key, no pairs; nulls are a key too)."""
    last_ok = runs.filter("success").groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(
        F.max("started_at").alias("_last_ok"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    f = runs.filter(~F.col("success")).join(last_ok, same, "left")
    return (f.filter(F.col("_last_ok").isNull() | (F.col("_last_ok") <= F.col("started_at")))
            .drop("_last_ok", *(f"_{k}" for k in key)))
