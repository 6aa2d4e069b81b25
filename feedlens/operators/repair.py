"""Repair (R1–R7) and conformance (V2–V4) of typed step outputs, as column rewrites.

Inputs carry the step's fields as top-level columns. Each repair appends a tag to
`repairs` (R7); conformance yields `violations` (rule names) and `valid`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import strip_ws


def _tags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(tag)) for cond, tag in pairs]))


def _empty_list(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def _falsy_str(c: Column) -> Column:
    return c.isNull() | (c == "")


def repair_extract(df: DataFrame) -> DataFrame:
    """R1–R3 (K14: out-of-range scores are left for V2)."""
    pp, vd = F.col("pain_points"), F.col("value_drivers")
    ps, do = F.col("problem_statement"), F.col("desired_outcome")
    fill = F.array(F.lit(S.TEXT_NOT_SPECIFIED_ITEM))
    tags = _tags((_empty_list(pp), "extraction_missing_field:pain_points"),
                 (_empty_list(vd), "extraction_missing_field:value_drivers"),
                 (_falsy_str(ps), "extraction_missing_field:problem_statement"),
                 (_falsy_str(do), "extraction_missing_field:desired_outcome"))
    return (df.withColumn("repairs", tags)
            .withColumn("pain_points", F.when(_empty_list(pp), fill).otherwise(pp))
            .withColumn("value_drivers", F.when(_empty_list(vd), fill).otherwise(vd))
            .withColumn("stakeholders", F.coalesce(F.col("stakeholders"), F.array().cast("array<string>")))
            .withColumn("confidence_score", F.coalesce(F.col("confidence_score"), F.lit(S.DEFAULT_CONFIDENCE)))
            .withColumn("problem_statement", F.when(_falsy_str(ps), F.lit(S.TEXT_PROBLEM_MISSING)).otherwise(ps))
            .withColumn("desired_outcome", F.when(_falsy_str(do), F.lit(S.TEXT_OUTCOME_MISSING)).otherwise(do)))


def repair_self_check(df: DataFrame) -> DataFrame:
    """R4."""
    approved = F.coalesce(F.col("approved"), F.lit(False))
    reason = F.col("rejection_reason")
    return (df.withColumn("verifications",
                          F.coalesce(F.col("verifications"), F.array().cast(S.SELF_CHECK["verifications"].dataType)))
            .withColumn("overall_accuracy", F.coalesce(F.col("overall_accuracy"), F.lit(S.DEFAULT_ACCURACY)))
            .withColumn("hallucination_risk", F.coalesce(F.col("hallucination_risk"), F.lit(S.DEFAULT_RISK)))
            .withColumn("approved", approved)
            .withColumn("rejection_reason",
                        F.when(~approved & _falsy_str(reason), F.lit(S.TEXT_SELF_CHECK_REJECTED)).otherwise(reason)))


def _title(field: str) -> str:
    return " ".join(w.capitalize() for w in field.split("_"))


def repair_value_prop(df: DataFrame) -> DataFrame:
    """R5/R6 (K17: null points count as none); persona defaults to executive (K9)."""
    tp = F.coalesce(F.col("key_talking_points"), F.array().cast("array<string>"))
    n = F.size(tp)
    pad = F.transform(F.sequence(n + 1, F.lit(S.MIN_TALKING_POINTS)),
                      lambda i: F.concat(F.lit(S.TEXT_TALKING_POINT_PAD), i.cast("string")))
    fixed = (F.when(n < S.MIN_TALKING_POINTS, F.concat(tp, pad))
             .when(n > S.MAX_TALKING_POINTS, F.slice(tp, 1, S.MAX_TALKING_POINTS)).otherwise(tp))
    pairs = [(n < S.MIN_TALKING_POINTS, "value_prop_padding_talking_points:key_talking_points")]
    out = df
    for f in S.VALUE_PROP_REQUIRED_FIELDS:
        bad = F.col(f).isNull() | (strip_ws(F.col(f)) == "")
        pairs.append((bad, f"value_prop_missing_field:{f}"))
    out = out.withColumn("repairs", _tags(*pairs)).withColumn("key_talking_points", fixed)
    for f in S.VALUE_PROP_REQUIRED_FIELDS:
        bad = F.col(f).isNull() | (strip_ws(F.col(f)) == "")
        out = out.withColumn(f, F.when(bad, F.lit(f"{_title(f)} not specified")).otherwise(F.col(f)))
    return out.withColumn("persona", F.coalesce(F.col("persona"), F.lit(S.DEFAULT_PERSONA)))


def repair_counts(*repaired: DataFrame) -> DataFrame:
    """Repairs per (event, field) over any number of repaired tables."""
    tags = None
    for df in repaired:
        t = df.select(F.explode("repairs").alias("tag"))
        tags = t if tags is None else tags.unionByName(t)
    parts = F.split("tag", ":")
    return (tags.select(parts[0].alias("event"), parts[1].alias("field"))
            .groupBy("event", "field").agg(F.count(F.lit(1)).alias("n")))


def _in01(c: Column) -> Column:
    return (c >= 0) & (c <= 1)


def _with_violations(df: DataFrame, pairs: list[tuple[Column, str]]) -> DataFrame:
    """Rule names that fail, plus any `type_errors` the parser reported (§7.4)."""
    v = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in pairs]))
    if "type_errors" in df.columns:
        v = F.concat(v, F.coalesce(F.col("type_errors"), F.array().cast("array<string>")))
    return df.withColumn("violations", v).withColumn("valid", F.size("violations") == 0)


def conform_extract(df: DataFrame) -> DataFrame:
    """V2 + V3 on repaired extraction: items are stripped, blank items and ranges are rules."""
    pp, vd = F.col("pain_points"), F.col("value_drivers")
    blank = lambda arr: F.exists(arr, lambda x: x.isNull() | (strip_ws(x) == ""))
    out = _with_violations(df, [
        (F.col("problem_statement").isNull(), "problem_statement_required"),
        (F.col("desired_outcome").isNull(), "desired_outcome_required"),
        (F.size(pp) < 1, "pain_points_min_items"),
        (blank(pp), "pain_points_blank_item"),
        (F.size(vd) < 1, "value_drivers_min_items"),
        (blank(vd), "value_drivers_blank_item"),
        (~_in01(F.col("confidence_score")), "confidence_score_range"),
    ])
    return (out.withColumn("pain_points", F.transform(pp, strip_ws))
            .withColumn("value_drivers", F.transform(vd, strip_ws)))


def conform_self_check(df: DataFrame) -> DataFrame:
    claims = F.col("verifications")
    return _with_violations(df, [
        (~_in01(F.col("overall_accuracy")), "overall_accuracy_range"),
        (~_in01(F.col("hallucination_risk")), "hallucination_risk_range"),
        (F.exists(claims, lambda c: ~F.coalesce(_in01(c["confidence"]), F.lit(False))), "claim_confidence_range"),
        (F.exists(claims, lambda c: c["claim"].isNull() | c["supported_by_input"].isNull()), "claim_required"),
    ])


def conform_value_prop(df: DataFrame) -> DataFrame:
    tp = F.col("key_talking_points")
    return _with_violations(df, [
        (F.length("headline") > S.MAX_HEADLINE_CHARS, "headline_max_length"),
        (F.size(tp) < S.MIN_TALKING_POINTS, "key_talking_points_min_items"),
        (F.size(tp) > S.MAX_TALKING_POINTS, "key_talking_points_max_items"),
        (~F.col("persona").isin(*S.PERSONAS), "persona_enum"),
    ])


def conform_config(df: DataFrame) -> DataFrame:
    """V4: model-config bounds (K19: temperature 0–2)."""
    t = F.col("temperature")
    return _with_violations(df, [
        (~((t >= 0) & (t <= 2)), "temperature_range"),
        (~(F.col("max_tokens") > 0), "max_tokens_positive"),
        (~(F.col("timeout_seconds") > 0), "timeout_positive"),
        (~F.col("provider").isin(*S.PROVIDERS), "provider_enum"),
    ])


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with the violated rule names)."""
    return df.filter("valid"), df.filter(~F.col("valid")).withColumn("reason", F.array_join("violations", ","))
