"""Queries for repair (R1–R7) and conformance (V2–V4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair as RP
from ..sources import fixtures as FX
from . import sql_snippets as Q
from .catalog import query


def _j(c):
    return F.array_join(c, "|")


def repaired_extract(spark, sf):
    return RP.repair_extract(FX.fx_extracted(spark, sf))


def repaired_self_check(spark, sf):
    return RP.repair_self_check(FX.fx_self_check(spark, sf))


def repaired_value_prop(spark, sf):
    return RP.repair_value_prop(FX.fx_value_prop(spark, sf))


EXTRACT_REPAIRED = """
SELECT run_id, doc_id,
  CASE WHEN problem_statement IS NULL OR problem_statement = '' THEN 'Customer problem not clearly specified'
       ELSE problem_statement END AS problem_statement,
  CASE WHEN desired_outcome IS NULL OR desired_outcome = '' THEN 'Desired outcome not specified'
       ELSE desired_outcome END AS desired_outcome,
  CASE WHEN pain_points IS NULL OR len(pain_points) = 0 THEN ['Not specified in input'] ELSE pain_points END AS pain_points,
  CASE WHEN value_drivers IS NULL OR len(value_drivers) = 0 THEN ['Not specified in input'] ELSE value_drivers END AS value_drivers,
  coalesce(stakeholders, CAST([] AS VARCHAR[])) AS stakeholders,
  coalesce(confidence_score, 0.5) AS confidence_score,
  list_filter([
    CASE WHEN pain_points IS NULL OR len(pain_points) = 0 THEN 'extraction_missing_field:pain_points' END,
    CASE WHEN value_drivers IS NULL OR len(value_drivers) = 0 THEN 'extraction_missing_field:value_drivers' END,
    CASE WHEN problem_statement IS NULL OR problem_statement = '' THEN 'extraction_missing_field:problem_statement' END,
    CASE WHEN desired_outcome IS NULL OR desired_outcome = '' THEN 'extraction_missing_field:desired_outcome' END],
    lambda x: x IS NOT NULL) AS repairs
FROM fx_extracted"""


@query("repair_extract", f"""
SELECT run_id, problem_statement, desired_outcome, array_to_string(pain_points, '|') AS pain_points,
       array_to_string(value_drivers, '|') AS value_drivers, array_to_string(stakeholders, '|') AS stakeholders,
       confidence_score, array_to_string(repairs, ',') AS repairs
FROM ({EXTRACT_REPAIRED})""")
def repair_extract(spark, sf):
    r = repaired_extract(spark, sf)
    return r.select("run_id", "problem_statement", "desired_outcome", _j("pain_points").alias("pain_points"),
                    _j("value_drivers").alias("value_drivers"), _j("stakeholders").alias("stakeholders"),
                    "confidence_score", F.array_join("repairs", ",").alias("repairs"))


SELF_CHECK_REPAIRED = """
SELECT run_id, CASE WHEN n_claims = -1 THEN 0 ELSE n_claims END AS n_claims,
  coalesce(overall_accuracy, 0.5) AS overall_accuracy, coalesce(hallucination_risk, 0.5) AS hallucination_risk,
  coalesce(approved, FALSE) AS approved,
  CASE WHEN NOT coalesce(approved, FALSE) AND (rejection_reason IS NULL OR rejection_reason = '')
       THEN 'Self-check did not approve extraction' ELSE rejection_reason END AS rejection_reason
FROM fx_self_check"""


@query("repair_self_check", SELF_CHECK_REPAIRED)
def repair_self_check(spark, sf):
    r = repaired_self_check(spark, sf)
    return r.select("run_id", F.size("verifications").alias("n_claims"), "overall_accuracy",
                    "hallucination_risk", "approved", "rejection_reason")


def _vp_fix(f: str, title: str) -> str:
    return f"CASE WHEN {f} IS NULL OR {Q.strip(f)} = '' THEN '{title} not specified' ELSE {f} END"


def _vp_tag(f: str) -> str:
    return f"CASE WHEN {f} IS NULL OR {Q.strip(f)} = '' THEN 'value_prop_missing_field:{f}' END"


VALUE_PROP_REPAIRED = f"""
SELECT run_id, {_vp_fix('headline', 'Headline')} AS headline, {_vp_fix('problem', 'Problem')} AS problem,
  {_vp_fix('solution', 'Solution')} AS solution, {_vp_fix('differentiation', 'Differentiation')} AS differentiation,
  {_vp_fix('call_to_action', 'Call To Action')} AS call_to_action, coalesce(persona, 'executive') AS persona,
  CASE WHEN len(coalesce(key_talking_points, CAST([] AS VARCHAR[]))) < 3 THEN
         list_concat(coalesce(key_talking_points, CAST([] AS VARCHAR[])),
                     list_transform(range(len(coalesce(key_talking_points, CAST([] AS VARCHAR[]))) + 1, 4),
                                    lambda i: 'Additional value point ' || CAST(i AS VARCHAR)))
       WHEN len(key_talking_points) > 5 THEN key_talking_points[1:5]
       ELSE key_talking_points END AS key_talking_points,
  list_filter([
    CASE WHEN len(coalesce(key_talking_points, CAST([] AS VARCHAR[]))) < 3
         THEN 'value_prop_padding_talking_points:key_talking_points' END,
    {_vp_tag('headline')}, {_vp_tag('problem')}, {_vp_tag('solution')}, {_vp_tag('differentiation')},
    {_vp_tag('call_to_action')}], lambda x: x IS NOT NULL) AS repairs
FROM fx_value_prop"""


@query("repair_value_prop", f"""
SELECT run_id, headline, differentiation, call_to_action, persona,
       array_to_string(key_talking_points, '|') AS key_talking_points, array_to_string(repairs, ',') AS repairs
FROM ({VALUE_PROP_REPAIRED})""")
def repair_value_prop(spark, sf):
    r = repaired_value_prop(spark, sf)
    return r.select("run_id", "headline", "differentiation", "call_to_action", "persona",
                    _j("key_talking_points").alias("key_talking_points"),
                    F.array_join("repairs", ",").alias("repairs"))


@query("repair_counts", f"""
SELECT split_part(tag, ':', 1) AS event, split_part(tag, ':', 2) AS field, count(*) AS n
FROM (SELECT unnest(repairs) AS tag FROM ({EXTRACT_REPAIRED})
      UNION ALL SELECT unnest(repairs) FROM ({VALUE_PROP_REPAIRED}))
GROUP BY 1, 2""")
def repair_counts(spark, sf):
    return RP.repair_counts(repaired_extract(spark, sf), repaired_value_prop(spark, sf))


def _blank_any(arr: str) -> str:
    return f"len(list_filter({arr}, lambda x: x IS NULL OR {Q.strip('x')} = '')) > 0"


EXTRACT_CONFORMED = f"""
SELECT *, len(v) = 0 AS valid FROM (SELECT *, list_filter([
  CASE WHEN problem_statement IS NULL THEN 'problem_statement_required' END,
  CASE WHEN desired_outcome IS NULL THEN 'desired_outcome_required' END,
  CASE WHEN len(pain_points) < 1 THEN 'pain_points_min_items' END,
  CASE WHEN {_blank_any('pain_points')} THEN 'pain_points_blank_item' END,
  CASE WHEN len(value_drivers) < 1 THEN 'value_drivers_min_items' END,
  CASE WHEN {_blank_any('value_drivers')} THEN 'value_drivers_blank_item' END,
  CASE WHEN NOT (confidence_score >= 0 AND confidence_score <= 1) THEN 'confidence_score_range' END],
  lambda x: x IS NOT NULL) AS v FROM ({EXTRACT_REPAIRED}))"""


@query("conform_extract", f"""
SELECT run_id, valid, array_to_string(v, ',') AS violations,
       array_to_string(list_transform(pain_points, lambda x: {Q.strip('x')}), '|') AS pain_points
FROM ({EXTRACT_CONFORMED})""")
def conform_extract(spark, sf):
    c = RP.conform_extract(repaired_extract(spark, sf))
    return c.select("run_id", "valid", F.array_join("violations", ",").alias("violations"),
                    _j("pain_points").alias("pain_points"))


SELF_CHECK_CONFORMED = f"""
SELECT *, len(v) = 0 AS valid FROM (SELECT *, list_filter([
  CASE WHEN NOT (overall_accuracy >= 0 AND overall_accuracy <= 1) THEN 'overall_accuracy_range' END,
  CASE WHEN NOT (hallucination_risk >= 0 AND hallucination_risk <= 1) THEN 'hallucination_risk_range' END],
  lambda x: x IS NOT NULL) AS v FROM ({SELF_CHECK_REPAIRED}))"""


@query("conform_self_check", f"""
SELECT run_id, valid, array_to_string(v, ',') AS violations FROM ({SELF_CHECK_CONFORMED})""")
def conform_self_check(spark, sf):
    c = RP.conform_self_check(repaired_self_check(spark, sf))
    return c.select("run_id", "valid", F.array_join("violations", ",").alias("violations"))


VALUE_PROP_CONFORMED = f"""
SELECT *, len(v) = 0 AS valid FROM (SELECT *, list_filter([
  CASE WHEN length(headline) > 200 THEN 'headline_max_length' END,
  CASE WHEN len(key_talking_points) < 3 THEN 'key_talking_points_min_items' END,
  CASE WHEN len(key_talking_points) > 5 THEN 'key_talking_points_max_items' END,
  CASE WHEN persona NOT IN ('executive','technical','business_user','procurement') THEN 'persona_enum' END],
  lambda x: x IS NOT NULL) AS v FROM ({VALUE_PROP_REPAIRED}))"""


@query("conform_value_prop", f"""
SELECT run_id, valid, array_to_string(v, ',') AS violations FROM ({VALUE_PROP_CONFORMED})""")
def conform_value_prop(spark, sf):
    c = RP.conform_value_prop(repaired_value_prop(spark, sf))
    return c.select("run_id", "valid", F.array_join("violations", ",").alias("violations"))


def fx_configs(spark, sf):
    r = FX.fx_runs(spark, sf)
    return r.select("run_id", "provider",
                    ((F.col("event_id") % 25).cast("double") / 10).alias("temperature"),
                    ((F.col("event_id") % 7) * 500).alias("max_tokens"),
                    ((F.col("event_id") % 4) * 15).alias("timeout_seconds"))


@query("conform_config", """
SELECT run_id, len(v) = 0 AS valid, array_to_string(v, ',') AS violations
FROM (SELECT run_id, list_filter([
  CASE WHEN NOT (t >= 0 AND t <= 2) THEN 'temperature_range' END,
  CASE WHEN NOT (mt > 0) THEN 'max_tokens_positive' END,
  CASE WHEN NOT (ts > 0) THEN 'timeout_positive' END], lambda x: x IS NOT NULL) AS v
  FROM (SELECT run_id, CAST(event_id % 25 AS DOUBLE) / 10 AS t, (event_id % 7) * 500 AS mt,
               (event_id % 4) * 15 AS ts FROM fx_runs))""")
def conform_config(spark, sf):
    c = RP.conform_config(fx_configs(spark, sf))
    return c.select("run_id", "valid", F.array_join("violations", ",").alias("violations"))


@query("conform_rejects", f"""
SELECT run_id, array_to_string(v, ',') AS reason
FROM (SELECT run_id, list_filter([
  CASE WHEN NOT (overall_accuracy >= 0 AND overall_accuracy <= 1) THEN 'overall_accuracy_range' END,
  CASE WHEN NOT (hallucination_risk >= 0 AND hallucination_risk <= 1) THEN 'hallucination_risk_range' END],
  lambda x: x IS NOT NULL) AS v FROM ({SELF_CHECK_REPAIRED})) WHERE len(v) > 0""")
def conform_rejects(spark, sf):
    _, bad = RP.split_valid(RP.conform_self_check(repaired_self_check(spark, sf)))
    return bad.select("run_id", "reason")
