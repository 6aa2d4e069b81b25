"""Views over the driver's tables that stand in for service inputs (FIXTURES.md §2).

Every view is a projection/aggregation of a whole driver table, so its size grows with the
data. The same definitions are written once more in DuckDB SQL in `plans/fixture_sql.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import keys
from .tables import table

BASE_EPOCH = 1704067200  # 2024-01-01T00:00:00Z


def _pick(idx: Column, values: list) -> Column:
    """values[idx] for a small fixed list, as a CASE expression."""
    out = None
    for i, v in enumerate(values):
        out = F.when(idx == i, v) if out is None else out.when(idx == i, v)
    return out


def fx_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("request_id"),
        "doc_id",
        F.col("text").alias("content"),
        "source",
        F.concat(F.lit("cust-"), (F.col("doc_id") % 100).cast("string")).alias("customer_id"),
        "lang",
        F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("doc_id") * 60).alias("requested_at"),
    )


def fx_conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    # a conversation is a handful of turns, so the per-key list is small
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(
        F.array_join(F.transform(turns, lambda t: t["text"]), "\n").alias("content"))


def _pad4(c: Column) -> Column:
    return F.lpad((c % 10000).cast("string"), 4, "0")


def fx_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 5
    suffix = (
        F.when(k == 0, F.concat(F.lit(" Reach me at jane.doe"), F.col("doc_id").cast("string"),
                                F.lit("@example.com today.")))
        .when(k == 1, F.concat(F.lit(" Call +1 (555) 555-"), _pad4(F.col("doc_id")), F.lit(" after 5pm.")))
        .when(k == 2, F.concat(F.lit(" SSN 123-45-"), _pad4(F.col("doc_id")), F.lit(".")))
        .when(k == 3, F.concat(F.lit(" Card "),
                               F.when(F.col("doc_id") % 2 == 0, F.lit("4111 1111 1111 1111"))
                               .otherwise(F.lit("4111 1111 1111 1112")),
                               F.lit(" on file.")))
        .otherwise(F.lit(""))
    )
    return d.select(F.col("doc_id").cast("string").alias("request_id"), "doc_id",
                    F.concat(F.col("text"), suffix).alias("content"))


# --- model answers wrapped in eight text shapes -----------------------------------------

def _json_string(text: Column) -> Column:
    """A whole text as a JSON string; braces and brackets are escaped too, so the shapes below hold."""
    out = _inner(F.to_json(F.array(text)))
    for char, code in (("{", "007b"), ("}", "007d"), ("[", "005b"), ("]", "005d")):
        out = F.replace(out, F.lit(char), F.lit(f"\\u{code}"))
    return out


def _inner(text: Column) -> Column:
    return F.substr(text, F.lit(2), F.length(text) - 2)


def response_fields(d: DataFrame) -> DataFrame:
    """Expected field values for a documents frame (doc_id, text, lang, source)."""
    return d.select(
        "doc_id", "source",
        F.col("text").alias("problem_statement"),
        F.concat(F.lit("Outcome for "), F.col("source")).alias("desired_outcome"),
        F.array(F.concat(F.lit("pain "), F.col("lang")),
                F.concat(F.lit("cost "), F.col("source"))).alias("pain_points"),
        ((F.col("doc_id") % 10).cast("double") / 10).alias("confidence_score"),
    )


def fx_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    f = response_fields(d)
    f = f.withColumn("_problem", _json_string(F.col("problem_statement")))
    f = f.withColumn("_open", F.concat(
        F.lit('{"problem_statement":'), F.col("_problem"),
        F.lit(',"desired_outcome":'), _json_string(F.col("desired_outcome")),
        F.lit(',"pain_points":'), F.to_json("pain_points"),
        F.lit(',"confidence_score":'), F.col("confidence_score").cast("string")))
    payload = F.concat("_open", F.lit("}"))
    k = F.col("doc_id") % 8
    small = F.concat(F.lit('First {"problem_statement": '), F.col("_problem"),
                     F.lit(', "confidence_score": 0.'), (F.col("doc_id") % 10).cast("string"),
                     F.lit('} and {"desired_outcome": "x"} done.'))
    text = _pick(k, [
        payload,
        F.concat(F.lit("Here is the result:\n```json\n"), payload, F.lit("\n```\nThanks.")),
        F.concat(F.lit("Sure.\n```json\n"), payload, F.lit("\n")),
        F.concat(F.lit('Note {"a": 1} then '), payload, F.lit(" end.")),
        small,
        F.concat("_open", F.lit(",}")),
        F.concat(F.lit("Broken { start. "), payload, F.lit(" tail.")),
        F.concat(F.lit("No structured answer for "), F.col("source"), F.lit(".")),
    ])
    return f.select(F.col("doc_id").cast("string").alias("run_id"), "doc_id",
                    F.lit("extract").alias("step"), text.alias("content"))


# --- typed step outputs with holes ---------------------------------------------------------

def fx_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    k = F.col("doc_id") % 7
    empty = F.array().cast("array<string>")
    pain = (F.when(k == 1, empty).when(k == 2, F.lit(None).cast("array<string>"))
            .when(k == 6, F.array(F.lit("slow rollout"), F.lit("  ")))
            .otherwise(F.array(F.concat(F.lit("slow "), F.col("lang")), F.lit(" manual work "))))
    drivers = F.when(k == 2, empty).otherwise(F.array(F.lit("time"), F.lit("cost")))
    return d.select(
        F.col("doc_id").cast("string").alias("run_id"), "doc_id",
        F.when(k == 3, F.lit("")).otherwise(F.col("text")).alias("problem_statement"),
        F.lit(None).cast("string").alias("current_solution"),
        F.when(k == 5, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Outcome "), F.col("source"))).alias("desired_outcome"),
        pain.alias("pain_points"),
        drivers.alias("value_drivers"),
        F.when(k == 4, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("cfo")))
        .alias("stakeholders"),
        F.lit(None).cast("string").alias("timeline"),
        F.lit(None).cast("string").alias("budget_signals"),
        F.when(k == 4, F.lit(None).cast("double")).when(k == 6, F.lit(1.5))
        .otherwise((F.col("doc_id") % 10).cast("double") / 10).alias("confidence_score"),
    )


def fx_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # labels cover a subset of documents; equi join on the key, Spark/AQE pick the strategy
    j = d.join(lab, "doc_id", "left")
    k = F.col("doc_id") % 7
    claim_a = F.struct(F.lit("claim a").alias("claim"), F.lit(True).alias("supported_by_input"),
                       F.lit("ev").alias("evidence"), F.lit(0.9).alias("confidence"))
    claim_b = F.struct(F.lit("claim b").alias("claim"),
                       (F.col("doc_id") % 2 == 0).alias("supported_by_input"),
                       F.lit(None).cast("string").alias("evidence"), F.lit(0.6).alias("confidence"))
    ver = (F.when(k == 1, F.lit(None).cast(S.SELF_CHECK["verifications"].dataType))
           .when(k == 5, F.array(claim_a, claim_b)).otherwise(F.array(claim_a)))
    approved = F.when(k == 6, F.lit(None).cast("boolean")).otherwise(F.col("quality") == 1)
    return j.select(
        F.col("doc_id").cast("string").alias("run_id"), "doc_id",
        ver.alias("verifications"),
        F.when(k == 2, F.lit(None).cast("double")).when(k == 4, F.lit(1.2))
        .otherwise((F.col("doc_id") % 5 + 6).cast("double") / 10).alias("overall_accuracy"),
        (F.col("toxic").cast("double") * 0.5 + 0.1).alias("hallucination_risk"),
        approved.alias("approved"),
        F.when((k == 3) | (k == 6), F.lit(None).cast("string"))
        .otherwise(F.when(F.col("quality") == 1, F.lit(None).cast("string"))
                   .otherwise(F.lit("Claims not supported"))).alias("rejection_reason"),
    )


def fx_value_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    k = F.col("doc_id") % 7
    pts = _pick(k, [
        F.array(F.lit("p1")),
        F.array(F.lit("p1"), F.lit("p2"), F.lit("p3")),
        F.array(*[F.lit(f"p{i}") for i in range(1, 7)]),
        F.lit(None).cast("array<string>"),
        F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"), F.lit("p4")),
        F.array(F.lit("p1"), F.lit("p2")),
        F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"), F.lit("p4"), F.lit("p5")),
    ])
    # every third headline is the whole text: most are over 200 characters, which V2 refuses
    headline = (F.when(k == 4, F.lit("")).when(k == 5, F.rpad(F.lit("H"), 201, "x"))
                .when(F.col("doc_id") % 3 == 0, F.col("text"))
                .otherwise(F.concat(F.lit("Less manual work for "), F.col("source"))))
    return d.select(
        F.col("doc_id").cast("string").alias("run_id"), "doc_id",
        headline.alias("headline"),
        F.concat(F.lit("Problem of "), F.col("source")).alias("problem"),
        F.lit("Automate the workflow").alias("solution"),
        F.when(k == 2, F.lit(None).cast("string")).otherwise(F.lit("Faster than manual"))
        .alias("differentiation"),
        F.lit(None).cast("string").alias("quantified_value"),
        F.when(k == 6, F.lit("   ")).otherwise(F.lit("Book a demo")).alias("call_to_action"),
        F.when(k == 1, F.lit("technical")).otherwise(F.lit(None).cast("string")).alias("persona"),
        pts.alias("key_talking_points"),
    )


# --- run log views -------------------------------------------------------------------------

def run_start(event_id: Column, ts: Column) -> Column:
    """Every 13th run starts on a whole second, as a log line without a fraction."""
    t = ts.cast("timestamp")
    return F.when(event_id % 13 == 0, F.date_trunc("second", t)).otherwise(t)


def run_raises(event_id: Column) -> Column:
    """Of the failed runs, those that raise; the others end in a failed result."""
    return event_id % 5 != 0


def fx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    p = e.event_id % 3
    started = run_start(F.col("event_id"), F.col("ts"))
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").cast("string").alias("run_id"), "event_id",
        started.alias("started_at"),
        F.timestamp_micros(F.unix_micros(started) + F.round(F.col("value") * 100000).cast("long"))
        .alias("completed_at"),
        "user_id",
        # three successive runs, one of each provider, work on the same note
        F.floor(F.col("event_id") / 3).alias("input_key"),
        F.concat(F.lit("cust-"), F.col("user_id").cast("string")).alias("customer_id"),
        _pick(F.col("user_id") % 4, [F.lit("crm"), F.lit("email"), F.lit("call"), F.lit("manual")])
        .alias("source"),
        _pick(p, [F.lit("openai"), F.lit("anthropic"), F.lit("google")]).alias("provider"),
        _pick(p, [F.lit("gpt-4o-mini"), F.lit("claude-sonnet-4-5"), F.lit(S.DEFAULT_MODEL)])
        .alias("model"),
        (~failed).alias("success"),
        (failed & run_raises(F.col("event_id"))).alias("raised"),  # the others end in a failed result
        (F.col("event_id") % 10 < 7).alias("approved"),
        _pick(F.col("user_id") % 3, [F.lit("dev"), F.lit("staging"), F.lit("prod")]).alias("environment"),
        (F.col("event_type") == "view").alias("from_cache"),
        "value",
        (F.col("value") / 10).alias("duration_s"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"),
        (F.col("value") / 10000).alias("cost_usd"),
        (F.lit(100) + (F.col("event_id") * 37) % 900).alias("tokens_input"),
        (F.lit(50) + (F.col("event_id") * 13) % 450).alias("tokens_output"),
        ((F.col("event_id") % 5 + 6).cast("double") / 10).alias("accuracy"),
        ((F.col("event_id") % 10).cast("double") / 10).alias("risk"),
        F.when(F.col("event_type") == "error", F.lit("Provider timeout")).alias("error"),
    )


STEP_WEIGHTS = [("ingest", 0, 10, 0), ("extract", 1, 30, 10), ("self_check", 2, 20, 40),
                ("rewrite", 3, 40, 60)]  # step, index, percent of run, percent before it


def fx_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx_runs(spark, sf_dir)
    steps = F.array(*[F.struct(F.lit(n).alias("step"), F.lit(i).alias("idx"),
                               F.lit(w).alias("w"), F.lit(c).alias("cum"))
                      for n, i, w, c in STEP_WEIGHTS])
    x = r.withColumn("s", F.explode(steps))
    fail_idx = F.col("event_id") % 4
    x = x.filter(F.col("success") | (F.col("s.idx") <= fail_idx))
    value = F.col("value")
    st = F.timestamp_micros(F.unix_micros("started_at") + F.round(value * F.col("s.cum") * 1000).cast("long"))
    return x.select(
        "run_id", "event_id", "provider", "model",
        F.col("s.step").alias("step"), F.col("s.idx").alias("step_idx"),
        F.when(~F.col("success") & (F.col("s.idx") == fail_idx), F.lit("failed"))
        .otherwise(F.lit("success")).alias("status"),
        st.alias("started_at"),
        F.timestamp_micros(F.unix_micros(st) + F.round(value * F.col("s.w") * 1000).cast("long"))
        .alias("completed_at"),
        F.floor(F.col("tokens_input") * F.col("s.w") / 100).cast("long").alias("tokens_input"),
        F.floor(F.col("tokens_output") * F.col("s.w") / 100).cast("long").alias("tokens_output"),
        (value * F.col("s.w") / 1000000.0).alias("cost_usd"),
    )


def fx_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log as JSON lines (one `value` string per event); every 101st run adds a cut line."""
    r = fx_runs(spark, sf_dir)

    def iso(c):
        # like the service's writer: no fraction when it is zero
        whole = F.unix_micros(c) % 1_000_000 == 0
        return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    start_ts, end_ts = iso("started_at"), iso("completed_at")
    none_s = F.lit(None).cast("string")
    none_b = F.lit(None).cast("boolean")
    none_d = F.lit(None).cast("double")
    none_l = F.lit(None).cast("long")

    def ev(name, level, ts, logger, success=none_b, cost=none_d, lat=none_l, err=none_s,
           key=none_s, field=none_s, cond=F.lit(True)):
        return F.when(cond, F.struct(
            F.lit(name).alias("event"), F.lit(level).alias("level"), ts.alias("timestamp"),
            F.lit(logger).alias("logger"), F.col("run_id").alias("run_id"),
            F.col("provider").alias("provider"), F.col("model").alias("model"),
            F.col("source").alias("source"), success.alias("success"),
            cost.alias("total_cost_usd"), lat.alias("total_latency_ms"), err.alias("error"),
            key.alias("cache_key"), field.alias("field")))

    key = keys.cache_key(F.col("run_id"), F.col("provider"), F.col("model"))
    events = F.array(
        ev(S.EV_STARTED, "info", start_ts, "app.api"),
        ev(S.EV_CACHE_HIT, "info", start_ts, "app.cache", key=key, cond=F.col("from_cache")),
        ev(S.EV_CACHE_MISS, "info", start_ts, "app.cache", key=key, cond=~F.col("from_cache")),
        ev(S.EV_COMPLETED, "info", end_ts, "app.api", success=F.lit(True), cost=F.col("cost_usd"),
           lat=F.col("duration_ms"), cond=F.col("success")),
        ev(S.EV_COMPLETED, "info", end_ts, "app.api", success=F.lit(False), cost=F.col("cost_usd"),
           lat=F.col("duration_ms"), cond=~F.col("success") & ~F.col("raised")),
        ev(S.EV_FAILED, "error", end_ts, "app.api", err=F.col("error"), cond=F.col("raised")),
        ev("extraction_missing_field", "warning", end_ts, "app.validator",
           field=F.lit("pain_points"), cond=F.col("event_id") % 7 == 0),
        ev("google_token_count_estimated", "warning", end_ts, "app.providers",
           field=F.lit("tokens_input"), cond=(F.col("event_id") % 11 == 0) & (F.col("provider") == "google")),
    )
    lines = F.concat(F.transform(F.array_compact(events), lambda e: F.to_json(e)),
                     F.when(F.col("event_id") % 101 == 0, F.array(F.lit('{"event": "workflow_exec')))
                     .otherwise(F.array().cast("array<string>")))
    return r.select(F.explode(lines).alias("value"))


def fx_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx_feedback(spark, sf_dir).filter(F.col("doc_id") % 3 == 0)
    again = f.filter(F.col("doc_id") % 9 == 0)
    first = f.select("doc_id", "content", "requested_at", F.lit(0).alias("version"))
    second = again.select("doc_id", "content",
                          (F.col("requested_at") + F.expr("INTERVAL 30 MINUTES")).alias("requested_at"),
                          F.lit(1).alias("version"))
    rows = first.unionByName(second)
    cost = ((F.col("doc_id") % 50 + F.col("version")).cast("double") / 10000)
    result = F.struct(
        F.concat(F.lit("cached-"), F.col("doc_id").cast("string"), F.lit("-"),
                 F.col("version").cast("string")).alias("run_id"),
        F.lit(123).cast("long").alias("total_latency_ms"),
        cost.alias("total_cost_usd"),
        F.lit(S.DEFAULT_PROVIDER).alias("provider_used"),
        F.lit(S.DEFAULT_MODEL).alias("model_used"),
        F.lit(True).alias("success"))
    return rows.select(
        keys.cache_key(F.col("content"), F.lit(S.DEFAULT_PROVIDER), F.lit(S.DEFAULT_MODEL)).alias("cache_key"),
        F.to_json(result).alias("result_json"),
        F.col("requested_at").alias("written_at"),
    )


ERROR_KINDS = ["ValueError", "TypeError", "TimeoutError", "RateLimitError"]


def fx_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx_runs(spark, sf_dir)
    kind = F.when(~F.col("success"), _pick(F.col("event_id") % 4, [F.lit(k) for k in ERROR_KINDS]))
    a1 = r.select("run_id", "event_id", "provider", "model", F.lit("extract").alias("step"),
                  F.lit(1).alias("attempt"), "success", kind.alias("error_kind"))
    a2 = (r.filter(~F.col("success") & (F.col("event_id") % 4 == 2))
          .select("run_id", "event_id", "provider", "model", F.lit("extract").alias("step"),
                  F.lit(2).alias("attempt"), (F.col("event_id") % 8 == 2).alias("success"))
          .withColumn("error_kind", F.when(~F.col("success"), F.lit("TimeoutError"))))
    return a1.unionByName(a2)
