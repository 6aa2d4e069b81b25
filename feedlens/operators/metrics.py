"""Metrics, log windows and alarms over the run log (MT1–MT10, A6, A7, L1–L10).

All aggregations are plain groupBy/agg (partial aggregation before the shuffle). Histograms are
one pass of conditional sums per label set, unpivoted afterwards (no bucket cross join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.exact import billed_cost, rsum
from ..session import cut_lineage

CORRUPT = "_corrupt_record"
LOG_LINE = T.StructType([*S.LOG_EVENT.fields, T.StructField(CORRUPT, T.StringType())])


def parse_log(lines: DataFrame, value: str = "value", events: tuple[str, ...] = ()) -> DataFrame:
    """JSON-lines events (already loaded as text) → typed rows with `ts`.

    With `events` only these are kept; lines that do not name one are dropped before they are parsed.

    A line that is no JSON object stays as a row of nulls with its text in `_corrupt_record`; a time
    that cannot be read is null. ISO times may lack the fraction, as the service's writer leaves it out.
    """
    for k, name in enumerate(events):
        named = F.contains(value, F.lit(f'"{name}"')) if k == 0 else named | F.contains(value, F.lit(f'"{name}"'))
    if events:
        lines = lines.filter(named)
    e = lines.select(F.from_json(value, LOG_LINE, {"columnNameOfCorruptRecord": CORRUPT}).alias("e")).select("e.*")
    e = e.withColumn("ts", F.col("timestamp").try_cast("timestamp"))
    return e.filter(F.col("event").isin(*events)) if events else e


def read_log(spark, path: str, stream: bool = False) -> DataFrame:
    """Read JSON-lines logs with the fixed schema, batch or as a stream (see `parse_log`)."""
    r = (spark.readStream if stream else spark.read).text(path)
    return parse_log(r)


def unreadable_lines(log: DataFrame) -> DataFrame:
    """How many lines of a log are no JSON object, and how many have no readable time."""
    bad = F.col(CORRUPT).isNotNull()
    return log.agg(F.count_if(bad).alias("corrupt_lines"), F.count_if(~bad & F.col("ts").isNull()).alias("bad_times"))


def le_label(b: float) -> str:
    return repr(float(b))


def histogram(df: DataFrame, labels: list[str], value: str, buckets: list[float], metric: str) -> DataFrame:
    """Cumulative histogram in long form: metric, labels…, le, value (+ _sum and _count rows)."""
    v = F.col(value)
    aggs = [F.sum(F.when(v <= F.lit(b), 1).otherwise(0)).cast("double").alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(v).cast("double").alias("cnt"), rsum(v).alias("total")]
    a = df.groupBy(*labels).agg(*aggs)
    rows = [F.struct(F.lit(f"{metric}_bucket").alias("metric"), F.lit(le_label(b)).alias("le"),
                     F.col(f"b{i}").alias("value")) for i, b in enumerate(buckets)]
    rows += [F.struct(F.lit(f"{metric}_bucket").alias("metric"), F.lit("+Inf").alias("le"), F.col("cnt").alias("value")),
             F.struct(F.lit(f"{metric}_count").alias("metric"), F.lit(None).cast("string").alias("le"),
                      F.col("cnt").alias("value")),
             F.struct(F.lit(f"{metric}_sum").alias("metric"), F.lit(None).cast("string").alias("le"),
                      F.col("total").alias("value"))]
    return a.select(*labels, F.explode(F.array(*rows)).alias("r")).select(
        F.col("r.metric").alias("metric"), *labels, F.col("r.le").alias("le"), F.col("r.value").alias("value"))


def _execution_labels(runs: DataFrame) -> DataFrame:
    """provider, model, status of every run; one that raised is an error of unknown provider and model."""
    raised = F.coalesce(F.col("raised"), F.lit(False)) if "raised" in runs.columns else F.lit(False)
    unknown = lambda c: F.when(raised, F.lit("unknown")).otherwise(F.col(c)).alias(c)
    status = (F.when(raised, F.lit("error")).when(F.col("success"), F.lit("success"))
              .otherwise(F.lit("failure")))
    return runs.select(unknown("provider"), unknown("model"), status.alias("status"))


def executions(runs: DataFrame) -> DataFrame:
    """MT1: workflow_executions_total by provider, model, status."""
    return _execution_labels(runs).groupBy("provider", "model", "status").agg(F.count(F.lit(1)).alias("value"))


def with_result(runs: DataFrame) -> DataFrame:
    """MT2/MT3: runs that ended in a result; one that raised is not observed. A cache hit costs nothing (K8)."""
    return runs.filter(~F.col("raised")).withColumn("cost_usd", billed_cost())


def tokens(runs: DataFrame) -> DataFrame:
    """MT5: tokens_consumed_total by provider, model, type (unpivot then sum)."""
    u = runs.select("provider", "model", F.explode(F.array(
        F.struct(F.lit("input").alias("type"), F.col("tokens_input").alias("n")),
        F.struct(F.lit("output").alias("type"), F.col("tokens_output").alias("n")))).alias("t"))
    return u.groupBy("provider", "model", F.col("t.type").alias("type")).agg(F.sum("t.n").alias("value"))


def step_failures(steps: DataFrame) -> DataFrame:
    """MT7."""
    return (steps.filter(F.col("status") == "failed")
            .groupBy("step", "provider").agg(F.count(F.lit(1)).alias("value")))


def rejections(self_check: DataFrame) -> DataFrame:
    """MT9: self-check rejections by reason."""
    return (self_check.filter(~F.col("approved"))
            .groupBy(F.col("rejection_reason").alias("reason")).agg(F.count(F.lit(1)).alias("value")))


def rollup_executions(runs: DataFrame) -> DataFrame:
    """MT10: totals at every label level at once."""
    return (_execution_labels(runs).rollup("provider", "model", "status")
            .agg(F.count(F.lit(1)).alias("value"), F.grouping_id().alias("level")))


#: A stretch without events is filled period by period up to so many periods (a year of five minutes).
IDLE_PERIODS = 366 * 24 * 12


def active_now(runs: DataFrame) -> DataFrame:
    """MT4: the gauge's value when the last run has started; runs that end then have ended."""
    last = runs.agg(F.max("started_at").alias("_now"))
    done = F.coalesce(F.col("completed_at") <= F.col("_now"), F.lit(False))
    return (runs.select("started_at", "completed_at").join(F.broadcast(last))  # one row
            .agg(F.coalesce(F.count_if(F.col("started_at").isNotNull() & ~done), F.lit(0)).alias("value")))


def active_runs(runs: DataFrame, period: str = "5 minutes", idle: int = IDLE_PERIODS) -> DataFrame:
    """MT4: peak of the active-runs gauge per period, for every period from the first event to the last.

    +1 at start, −1 at end, ends first at equal times. Levels are built up from seconds: a running sum
    inside each second, then over the seconds of a period, then over periods, so the only one-task
    window sees one row per period that has events. A period's peak counts the level it is entered with.
    Periods between two events are filled in from the first of them; a stretch of more than `idle`
    periods is not (a stray time stamp would make millions of rows): there the level before it holds.
    """
    d = runs.select(F.explode(F.array(
        F.struct(F.col("started_at").alias("t"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col("completed_at").alias("t"), F.lit(-1).cast("long").alias("d")))).alias("x")).select("x.*")
    upto = (Window.unboundedPreceding, Window.currentRow)
    earlier = (Window.unboundedPreceding, -1)
    d = d.filter("t is not null").withColumn("second", F.date_trunc("second", "t"))
    d = d.withColumn("run", F.sum("d").over(Window.partitionBy("second").orderBy("t", "d").rowsBetween(*upto)))
    sec = d.groupBy("second").agg(F.max("run").alias("top"), F.sum("d").alias("net"))
    sec = sec.withColumn("bucket", F.window("second", period).start)
    entry = F.coalesce(F.sum("net").over(Window.partitionBy("bucket").orderBy("second").rowsBetween(*earlier)), F.lit(0))
    per = (sec.withColumn("top", F.col("top") + entry).groupBy("bucket")
           .agg(F.max("top").alias("top"), F.sum("net").alias("net")))
    order = Window.orderBy("bucket")
    step = F.expr(f"INTERVAL {period}")
    level = F.coalesce(F.sum("net").over(order.rowsBetween(*earlier)), F.lit(0))
    per = per.select("bucket", (level + F.greatest(F.lit(0), F.col("top"))).alias("peak"), (level + F.col("net")).alias("after"),
                     F.lead("bucket").over(order).alias("next"))
    near = (F.col("next") > F.col("bucket") + step) & (F.col("next") <= F.col("bucket") + step * idle)
    gap = F.when(near, F.sequence(F.col("bucket") + step, F.col("next") - step, step))
    own = F.array(F.struct("bucket", F.col("peak").cast("long").alias("peak_active")))
    quiet = F.transform(gap, lambda b: F.struct(b.alias("bucket"), F.col("after").cast("long").alias("peak_active")))
    return per.select(F.inline(F.concat(own, F.coalesce(quiet, F.filter(own, lambda x: F.lit(False))))))


def window_counts(events: DataFrame, period: str, value: Column | None = None) -> DataFrame:
    """L1–L3: per tumbling period, count (or sum of `value`)."""
    w = F.window("ts", period)
    agg = F.count(F.lit(1)).alias("n") if value is None else rsum(value).alias("n")
    return events.groupBy(w.start.alias("window_start")).agg(agg)


def alarm(counts: DataFrame, period_seconds: int, threshold: float = S.ALARM_THRESHOLD) -> DataFrame:
    """L4: Sum > threshold in each of 2 successive periods; a missing period is not breaching.

    Each breaching period stands for itself and for the predecessor of the next one; grouping both
    roles by period start pairs them up, so the counts are computed once and no spine is needed.
    """
    breach = counts.filter(F.col("n") > threshold)
    null = F.lit(None)
    later = F.col("window_start") + F.expr(f"INTERVAL {period_seconds} SECONDS")
    roles = F.array(F.struct(F.col("window_start").alias("w"), F.col("n").alias("n"), null.cast(counts.schema["n"].dataType).alias("p")),
                    F.struct(later.alias("w"), null.cast(counts.schema["n"].dataType).alias("n"), F.col("n").alias("p")))
    both = breach.select(F.explode(roles).alias("r")).groupBy(F.col("r.w").alias("window_start")).agg(
        F.max("r.n").alias("n"), F.max("r.p").alias("prev_n"))
    return both.filter("n is not null and prev_n is not null")


def sliding_rate(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute",
                 seconds: int = 300) -> DataFrame:
    """Events per second over a sliding window whose length is a multiple of its slide.

    Events are counted once, by panes of one slide; a window adds up its panes.
    """
    panes = events.groupBy(F.window("ts", slide).start.alias("ts")).agg(F.count(F.lit(1)).alias("_n"))
    w = F.window("ts", length, slide)
    return (panes.groupBy(w.start.alias("window_start"), w.end.alias("window_end"))
            .agg(F.sum("_n").alias("n")).withColumn("rate", F.round(F.col("n") / seconds, 6)))


def exact_percentiles(df: DataFrame, group: list[str], value: str, ps: list[float]) -> DataFrame:
    """Exact percentiles (linear interpolation, like `percentile`) without holding a group.

    Values are counted per (group, value) and range-partitioned by both, so a large group spans many
    partitions. Prefix sums over the partitions' totals (one row per partition and group) tell which of
    them hold a requested rank; only those are ranked row by row.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = df.filter(F.col(value).isNotNull()).groupBy(F.struct(*group).alias("_g"), F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    # range bounds are sampled, so the placement is written before it is used twice
    placed = cut_lineage(c.repartitionByRange(n, "_g", "_v").withColumn("_part", F.spark_partition_id()))
    per = placed.groupBy("_g", "_part").agg(F.sum("_c").alias("_s"))
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_off": F.coalesce(F.sum("_s").over(before), F.lit(0).cast("long")), "_n": F.sum("_s").over(whole)})
    rank = lambda p, f: f(F.lit(float(p)) * (F.col("_n") - 1))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), rank(p, f).cast("long").alias("r"), F.lit(up).alias("up"))
                       for p in ps for f, up in ((F.floor, 0), (F.ceil, 1))])
    here = F.filter(wanted, lambda w: (w["r"] >= F.col("_off")) & (w["r"] < F.col("_off") + F.col("_s")))
    per = per.withColumn("_w", here).filter(F.size("_w") > 0)
    w = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.join(per, ["_g", "_part"]).withColumn("_cum", F.sum("_c").over(w) + F.col("_off"))
    hits = rows.select("_g", "_v", "_n", "_cum", F.explode(F.filter("_w", lambda x: (x["r"] < F.col("_cum")) & (
        x["r"] >= F.col("_cum") - F.col("_c")))).alias("x"))
    a = hits.groupBy("_g", F.col("x.p").alias("p")).agg(
        F.max(F.when(F.col("x.up") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("x.up") == 1, F.col("_v"))).alias("_hi"), F.max("_n").alias("_n"))
    pos = F.col("p") * (F.col("_n") - 1)
    return a.select("_g.*", "p", (F.col("_lo") + (pos - F.floor(pos)) * (F.col("_hi") - F.col("_lo"))).alias("value"))


def approx_percentiles(df: DataFrame, group: list[str], value: str, ps: list[float],
                       accuracy: int = 10000) -> DataFrame:
    """L7 at scale: mergeable sketch, one pass."""
    return df.groupBy(*group).agg(F.percentile_approx(value, ps, accuracy).alias("values"))


def cache_hit_rate(log: DataFrame) -> DataFrame:
    """H7 from cache_hit / cache_miss events."""
    c = log.filter(F.col("event").isin(S.EV_CACHE_HIT, S.EV_CACHE_MISS))
    hit = (F.col("event") == S.EV_CACHE_HIT)
    return c.groupBy("provider").agg(F.sum(hit.cast("long")).alias("hits"), F.sum((~hit).cast("long")).alias("misses"),
                                     F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"))


def warnings(log: DataFrame) -> DataFrame:
    """Repair / fallback / estimate warnings per event and field."""
    return (log.filter(F.col("level") == "warning")
            .groupBy("event", "field").agg(F.count(F.lit(1)).alias("n")))


def _escaped(label: Column) -> Column:
    """A label value with backslash, quote and line feed escaped."""
    out = F.replace(label, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def _number(value: Column) -> Column:
    """A plain decimal with up to twelve places and no trailing zeros."""
    return F.regexp_replace(F.format_string("%.12f", value.cast("double")), r"\.?0+$", "")


def exposition(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Long-form samples → Prometheus text lines (`metric{l="v",…} value`)."""
    parts = [F.concat(F.lit(f'{lab}="'), _escaped(F.col(lab)), F.lit('"')) for lab in labels]
    if "le" in samples.columns:
        parts.append(F.when(F.col("le").isNotNull(), F.concat(F.lit('le="'), F.col("le"), F.lit('"'))))
    inside = F.concat_ws(",", *parts) if parts else F.lit("")
    braces = F.when(inside == "", F.lit("")).otherwise(F.concat(F.lit("{"), inside, F.lit("}")))
    return samples.select(F.concat(F.col("metric"), braces, F.lit(" "), _number(F.col("value"))).alias("line"))


def family(name: str, kind: str, text: str, samples: DataFrame, labels: list[str]) -> DataFrame:
    """A metric's HELP and TYPE lines before its samples (`pos` keeps the order)."""
    head = samples.sparkSession.createDataFrame(
        [(name, 0, f"# HELP {name} {text}"), (name, 1, f"# TYPE {name} {kind}")], "family string, pos int, line string")
    body = exposition(samples if "metric" in samples.columns else samples.withColumn("metric", F.lit(name)), labels)
    return head.unionByName(body.select(F.lit(name).alias("family"), F.lit(2).alias("pos"), "line"))


def registry(runs: DataFrame, steps: DataFrame, self_check: DataFrame) -> DataFrame:
    """All nine metrics as text lines (family, pos, line)."""
    done = with_result(runs)
    lasted = steps.withColumn("duration_s", (
        (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000).cast("long").cast("double") / 1000)
    now = active_runs(runs).agg(F.max_by("peak_active", "bucket").alias("value"))  # its peak in the last period
    by = ["provider", "model"]
    parts = [
        ("workflow_executions_total", executions(runs), [*by, "status"]),
        ("workflow_duration_seconds", histogram(done, by, "duration_s", S.DURATION_BUCKETS, "workflow_duration_seconds"), by),
        ("workflow_cost_usd", histogram(done, by, "cost_usd", S.COST_BUCKETS, "workflow_cost_usd"), by),
        ("tokens_consumed_total", tokens(runs), [*by, "type"]),
        ("agent_step_duration_seconds", histogram(lasted, ["step", "provider"], "duration_s", S.STEP_DURATION_BUCKETS,
                                                  "agent_step_duration_seconds"), ["step", "provider"]),
        ("agent_step_failures_total", step_failures(steps), ["step", "provider"]),
        ("hallucination_risk_score", histogram(runs, [], "risk", S.RISK_BUCKETS, "hallucination_risk_score"), []),
        ("self_check_rejections_total", rejections(self_check), ["reason"]),
        ("active_workflows", now, [])]
    out = None
    for name, samples, labels in parts:
        kind, text = S.METRICS[name]
        lines = family(name, kind, text, samples, labels)
        out = lines if out is None else out.unionByName(lines)
    return out


def write_text(lines: DataFrame, path: str) -> None:
    """A7 sink (no endpoint): one text file per partition."""
    lines.write.mode("overwrite").text(path)


def alert_rules(runs: DataFrame, error_rate: float = 0.05, p95_s: float = 10.0, rejection_rate: float = 0.3,
                cost_per_hour: float = 0.5) -> DataFrame:
    """Documented alert rules as windowed aggregates → alerts(rule, window_start, value, threshold)."""
    five = runs.groupBy(F.window("ts", "5 minutes").start.alias("window_start")).agg(
        F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("v"))
    hourly = runs.withColumn("window_start", F.window("ts", "1 hour").start)
    p95 = exact_percentiles(hourly, ["window_start"], "duration_s", [0.95]).withColumnRenamed("value", "v")
    h = hourly.groupBy("window_start").agg(
        F.avg(F.when(F.col("approved"), 0.0).otherwise(1.0)).alias("rej"), rsum(billed_cost()).alias("cost"))

    def rule(df, name, col, thr):
        return df.filter(F.col(col) > thr).select(F.lit(name).alias("rule"), "window_start",
                                                  F.round(col, 6).alias("value"), F.lit(thr).alias("threshold"))
    return (rule(five, "error_rate", "v", error_rate)
            .unionByName(rule(p95, "p95_latency_s", "v", p95_s))
            .unionByName(rule(h, "rejection_rate", "rej", rejection_rate))
            .unionByName(rule(h, "cost_per_hour", "cost", cost_per_hour)))


BUDGETS = [("dev", 10.0), ("staging", 100.0), ("prod", 1000.0)]  # USD per day


def budget_alert(runs: DataFrame, environment: str = "environment") -> DataFrame:
    """Daily billed cost per environment against its budget (3-row dimension, broadcast)."""
    daily = runs.groupBy(F.to_date("started_at").alias("day"), F.col(environment).alias("env")).agg(
        rsum(billed_cost()).alias("cost"))
    b = F.broadcast(runs.sparkSession.createDataFrame(BUDGETS, "env string, budget_usd double"))
    return daily.join(b, "env").select("day", "env", F.col("cost").alias("cost_usd"), "budget_usd",
                                       (F.col("cost") > F.col("budget_usd")).alias("over_budget"))
