"""Gate (G1–G4), assembly (W1, W2, W7), run totals (W3–W6) and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.exact import dsum, rsum, xsum


def gate_approved(self_check: DataFrame) -> DataFrame:
    """G1: only approved runs go on to the rewrite prompts."""
    return self_check.filter(F.col("approved"))


def threshold_pass(acc: str = "overall_accuracy", risk: str = "hallucination_risk",
                   min_acc: float = 0.7, max_risk: float = 0.3):
    """The documented rule accuracy > 0.7 and risk < 0.3."""
    return (F.col(acc) > min_acc) & (F.col(risk) < max_risk)


def gate_disagree(self_check: DataFrame) -> DataFrame:
    """Runs where the model's verdict and the threshold rule differ."""
    return (self_check.withColumn("threshold_pass", threshold_pass())
            .filter(F.col("approved") != F.col("threshold_pass")))


def claim_support(self_check: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run, number of claims and share supported (partial aggregation per key)."""
    c = self_check.select(key, F.explode_outer("verifications").alias("c"))
    return c.groupBy(key).agg(
        F.count("c").alias("n_claims"),
        F.sum(F.col("c.supported_by_input").cast("int")).alias("n_supported"),
        F.avg(F.col("c.supported_by_input").cast("double")).alias("support_rate"))


def _placeholder(schema: T.StructType, values: dict) -> Column:
    """A struct of fixed values; lists are given as lists, fields without a value are null."""
    def value(f):
        v = values.get(f.name)
        c = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        return c.cast(f.dataType).alias(f.name)
    return F.struct(*[value(f) for f in schema.fields])


def outcome(normalized: DataFrame, extract: DataFrame, self_check: DataFrame, value_prop: DataFrame,
            key: str = "run_id", strict_placeholders: bool = False, at: str = "processed_at") -> DataFrame:
    """One row for every run of `normalized`, from the conformed step tables.

    Step tables carry `valid` and `violations` from conformance. A run fails at the first step that is
    missing or invalid, or at the gate. K4: outputs of steps that finished are kept unless
    `strict_placeholders` asks for the service's all-placeholder error result. `at` (a column of
    `normalized`) dates the result, so that a recomputed partition gives the same rows.
    """
    def step(df, name, schema):
        return df.select(key, F.col("valid").alias(f"{name}_ok"), F.col("violations").alias(f"{name}_v"),
                         F.struct(*[F.col(f.name) for f in schema.fields]).alias(name))
    n = normalized.select(key, F.struct(*[F.col(at if f.name == "processed_at" else f.name).cast(f.dataType).alias(f.name)
                                          for f in S.NORMALIZED.fields]).alias("n"))
    j = (n.join(step(extract, "e", S.EXTRACTED), key, "left").join(step(self_check, "s", S.SELF_CHECK), key, "left")
         .join(step(value_prop, "v", S.VALUE_PROP), key, "left"))
    approved = F.coalesce(F.col("s.approved"), F.lit(False))
    broken = lambda step, name: F.concat(F.lit(f"{step}: "), F.array_join(f"{name}_v", ","))
    reason = F.coalesce(F.col("s.rejection_reason"), F.lit(S.TEXT_SELF_CHECK_REJECTED))
    error = (F.when(F.col("e_ok").isNull(), F.lit("extract: missing")).when(~F.col("e_ok"), broken("extract", "e"))
             .when(F.col("s_ok").isNull(), F.lit("self_check: missing")).when(~F.col("s_ok"), broken("self_check", "s"))
             .when(~approved, F.concat(F.lit("Self-check failed: "), reason))
             .when(F.col("v_ok").isNull(), F.lit("rewrite: missing")).when(~F.col("v_ok"), broken("rewrite", "v")))
    ok = error.isNull()
    no_vp = _placeholder(S.VALUE_PROP, {**S.ERROR_VALUE_PROP, "persona": S.DEFAULT_PERSONA})
    no_n = _placeholder(S.NORMALIZED, {"content": "", "language": "en", "detected_pii": [], "has_pii": False,
                                       "cleaned_content": "", "word_count": 0})
    no_s = _placeholder(S.SELF_CHECK, {"verifications": [], "overall_accuracy": 0.0, "hallucination_risk": 1.0,
                                       "approved": False})
    no_e = _placeholder(S.EXTRACTED, {"problem_statement": "", "desired_outcome": "", "pain_points": [S.ERROR_ITEM],
                                      "value_drivers": [S.ERROR_ITEM], "stakeholders": [], "confidence_score": 0.0})
    if strict_placeholders:
        keep_n = keep_e = keep_s = ok
    else:
        keep_n = F.lit(True)
        keep_e = F.coalesce("e_ok", F.lit(False))
        keep_s = keep_e & F.coalesce("s_ok", F.lit(False))
    dated = F.col("n.processed_at")
    return j.select(
        key,
        ok.alias("success"),
        error.alias("error"),
        F.when(ok, F.col("v")).otherwise(no_vp).withField("generated_at", dated).alias("value_proposition"),
        F.when(keep_n, F.col("n")).otherwise(no_n.withField("processed_at", dated)).alias("normalized_input"),
        F.when(keep_e, F.col("e")).otherwise(no_e).alias("extracted_data"),
        F.when(keep_s, F.col("s")).otherwise(no_s).alias("self_check"),
    )


def run_totals(steps: DataFrame, key: str = "run_id") -> DataFrame:
    """Sums per run, status (all steps succeeded and, with an `approved` column, the gate passed)
    and the error of the first step that failed."""
    dur = step_duration_ms(F.col("started_at"), F.col("completed_at"))
    fine = F.bool_and(F.col("status") == "success")
    error = F.min_by(F.col("error"), F.when(F.col("status") != "success", F.col("started_at"))) if "error" in steps.columns \
        else F.lit(None).cast("string")
    if "approved" in steps.columns:
        passed = F.coalesce(F.bool_and("approved"), F.lit(True))
        error = F.coalesce(error, F.when(~passed, F.lit(S.TEXT_SELF_CHECK_REJECTED)))
        fine = fine & passed
    return steps.groupBy(key).agg(
        rsum("cost_usd").alias("total_cost_usd"),
        F.sum("tokens_input").alias("total_tokens_input"),
        F.sum("tokens_output").alias("total_tokens_output"),
        F.sum(dur).alias("total_latency_ms"),
        F.count(F.lit(1)).alias("n_steps"),
        F.when(fine, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        error.alias("error"))


def step_duration_ms(started, completed):
    """int((completed − started) · 1000) in ms, truncated like Python's int()."""
    return ((F.unix_micros(completed) - F.unix_micros(started)) / 1000).cast("long")


def cost_by_step(steps: DataFrame) -> DataFrame:
    """Cost and latency per step with its share of the total."""
    dur = step_duration_ms(F.col("started_at"), F.col("completed_at"))
    agg = steps.groupBy("step").agg(rsum("cost_usd").alias("cost_usd"), xsum("cost_usd").alias("_c"),
                                    F.avg(dur).alias("avg_latency_ms"))
    total = dsum("_c").over(Window.partitionBy()).cast("double")
    return agg.select("step", "cost_usd", F.round("avg_latency_ms", 3).alias("avg_latency_ms"),
                      (F.col("_c") / total).alias("cost_share"))


def flatten(results: DataFrame) -> DataFrame:
    """Nested results → flat columns for csv (arrays joined with ' | ')."""
    cols = []
    for f in results.schema.fields:
        if hasattr(f.dataType, "fields"):
            for sub in f.dataType.fields:
                c = F.col(f"{f.name}.{sub.name}")
                if sub.dataType.typeName() == "array":
                    c = F.to_json(c) if sub.dataType.elementType.typeName() == "struct" else F.array_join(c, " | ")
                cols.append(c.alias(f"{f.name}__{sub.name}"))
        elif f.dataType.typeName() == "array":
            cols.append(F.array_join(F.col(f.name), " | ").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return results.select(*cols)


def export(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
           partition_by: tuple[str, ...] = ()) -> None:
    """parquet/json keep the nesting, csv gets the flat form; folders by `partition_by`."""
    out = flatten(results) if fmt == "csv" else results
    w = out.write.mode(mode).partitionBy(*partition_by) if partition_by else out.write.mode(mode)
    if fmt == "csv":  # quotes are doubled, as readers of csv expect
        w = w.option("header", "true").option("escape", '"')
    w.format(fmt).save(path)
