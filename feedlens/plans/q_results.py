"""Queries for the gate (G1–G4), assembly (W1, W2), totals (W3–W6) and flat export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import repair as RP
from ..operators import results as W
from ..sources import fixtures as FX
from ..streaming import jobs as ST
from . import sql_snippets as Q
from .catalog import query
from .sql_snippets import rsum, xsum
from .q_repair import (EXTRACT_CONFORMED, SELF_CHECK_CONFORMED, SELF_CHECK_REPAIRED, VALUE_PROP_CONFORMED,
                       repaired_extract, repaired_self_check, repaired_value_prop)


@query("gate_approved", f"SELECT run_id, overall_accuracy FROM ({SELF_CHECK_REPAIRED}) WHERE approved")
def gate_approved(spark, sf):
    return W.gate_approved(repaired_self_check(spark, sf)).select("run_id", "overall_accuracy")


@query("gate_threshold", f"""
SELECT run_id, overall_accuracy > 0.7 AND hallucination_risk < 0.3 AS threshold_pass FROM ({SELF_CHECK_REPAIRED})""")
def gate_threshold(spark, sf):
    return repaired_self_check(spark, sf).select("run_id", W.threshold_pass().alias("threshold_pass"))


@query("gate_disagree", f"""
SELECT run_id, approved, threshold_pass FROM (
  SELECT run_id, approved, overall_accuracy > 0.7 AND hallucination_risk < 0.3 AS threshold_pass
  FROM ({SELF_CHECK_REPAIRED})) WHERE approved <> threshold_pass""")
def gate_disagree(spark, sf):
    return W.gate_disagree(repaired_self_check(spark, sf)).select("run_id", "approved", "threshold_pass")


@query("claim_support", """
SELECT run_id, CAST(CASE WHEN n_claims = -1 THEN 0 ELSE n_claims END AS BIGINT) AS n_claims,
       CAST(CASE WHEN n_claims <= 0 THEN NULL ELSE n_supported END AS BIGINT) AS n_supported,
       CASE WHEN n_claims <= 0 THEN NULL ELSE CAST(n_supported AS DOUBLE) / n_claims END AS support_rate
FROM fx_self_check""")
def claim_support(spark, sf):
    c = W.claim_support(repaired_self_check(spark, sf))
    return c.select("run_id", "n_claims", F.col("n_supported").cast("long").alias("n_supported"), "support_rate")


def _normalized(spark, sf):
    n = I.normalize(FX.fx_pii(spark, sf))
    at = F.timestamp_seconds(F.lit(FX.BASE_EPOCH) + F.col("doc_id") * 60)
    return n.select(F.col("request_id").alias("run_id"), "content", F.lit("en").alias("language"), "detected_pii",
                    "has_pii", "cleaned_content", "word_count", at.alias("processed_at"))


def _outcome(spark, sf, strict=False):
    e = RP.conform_extract(repaired_extract(spark, sf))
    s = RP.conform_self_check(repaired_self_check(spark, sf))
    v = RP.conform_value_prop(repaired_value_prop(spark, sf))
    return W.outcome(_normalized(spark, sf), e, s, v, strict_placeholders=strict)


NORMALIZED_SQL = f"""
SELECT p.request_id AS run_id, {Q.strip('p.content')} AS content, coalesce(d.n, 0) AS n_pii,
  {Q.redact(Q.strip('p.content'))} AS cleaned_content, {Q.word_count('p.content')} AS word_count,
  make_timestamp((1704067200 + p.doc_id * 60) * 1000000) AS processed_at
FROM fx_pii p LEFT JOIN (SELECT request_id, count(*) AS n FROM ({Q.pii_rows(
    f"(SELECT request_id, {Q.strip('content')} AS content FROM fx_pii)")}) GROUP BY 1) d ON p.request_id = d.request_id"""

OUTCOME_SQL = f"""
SELECT e.run_id,
  CASE WHEN NOT e.valid THEN 'extract: ' || array_to_string(e.v, ',')
       WHEN NOT s.valid THEN 'self_check: ' || array_to_string(s.v, ',')
       WHEN NOT s.approved THEN 'Self-check failed: ' || s.rejection_reason
       WHEN NOT vp.valid THEN 'rewrite: ' || array_to_string(vp.v, ',') END AS error,
  e.valid AS e_ok, e.valid AND s.valid AS s_ok, e.problem_statement, e.desired_outcome,
  list_transform(e.pain_points, lambda x: {Q.strip('x')}) AS pain_points,
  list_transform(e.value_drivers, lambda x: {Q.strip('x')}) AS value_drivers, e.stakeholders, e.confidence_score,
  s.n_claims, s.overall_accuracy, s.hallucination_risk, s.approved, s.rejection_reason, vp.headline, vp.problem,
  vp.solution, vp.differentiation, vp.call_to_action, vp.persona, vp.key_talking_points,
  n.content, n.n_pii, n.cleaned_content, n.word_count, n.processed_at
FROM ({EXTRACT_CONFORMED}) e LEFT JOIN ({SELF_CHECK_CONFORMED}) s ON e.run_id = s.run_id
LEFT JOIN ({VALUE_PROP_CONFORMED}) vp ON e.run_id = vp.run_id JOIN ({NORMALIZED_SQL}) n ON e.run_id = n.run_id"""


def record_sql(strict: bool = False) -> str:
    """Every field of the flat result record (lists joined, claims and detections as counts)."""
    ok, n_ok = "error IS NULL", "error IS NULL" if strict else "TRUE"
    e_ok, s_ok = ("error IS NULL",) * 2 if strict else ("e_ok", "s_ok")
    vp = {"headline": "Workflow execution failed", "problem": "An error occurred during workflow execution",
          "solution": "Please check logs and try again", "differentiation": "N/A",
          "call_to_action": "Review error message and retry", "persona": "executive"}
    points = ("Workflow execution encountered an error | Check API keys and configuration | "
              "Review logs for detailed error information")

    def pick(cond, value, other, name):
        return f"CASE WHEN {cond} THEN {value} ELSE {other} END AS {name}"
    null = "CAST(NULL AS VARCHAR)"
    cols = ["run_id", f"{ok} AS success", "error"]
    cols += [pick(ok, k, f"'{v}'", f"value_proposition__{k}") for k, v in vp.items()]
    cols += [f"{null} AS value_proposition__quantified_value", "processed_at AS value_proposition__generated_at",
             pick(ok, "array_to_string(key_talking_points, ' | ')", f"'{points}'", "value_proposition__key_talking_points"),
             pick(n_ok, "content", "''", "normalized_input__content"), "'en' AS normalized_input__language",
             pick(n_ok, "n_pii", "0", "normalized_input__n_pii"), pick(n_ok, "n_pii > 0", "FALSE", "normalized_input__has_pii"),
             pick(n_ok, "cleaned_content", "''", "normalized_input__cleaned_content"),
             pick(n_ok, "word_count", "0", "normalized_input__word_count"), "processed_at AS normalized_input__processed_at"]
    cols += [pick(e_ok, k, "''", f"extracted_data__{k}") for k in ("problem_statement", "desired_outcome")]
    cols += [pick(e_ok, f"array_to_string({k}, ' | ')", v, f"extracted_data__{k}") for k, v in
             (("pain_points", "'Error'"), ("value_drivers", "'Error'"), ("stakeholders", "''"))]
    cols += [f"{null} AS extracted_data__{k}" for k in ("current_solution", "timeline", "budget_signals")]
    cols += [pick(e_ok, "confidence_score", "CAST(0.0 AS DOUBLE)", "extracted_data__confidence_score"),
             pick(s_ok, "n_claims", "0", "self_check__n_claims"),
             pick(s_ok, "overall_accuracy", "CAST(0.0 AS DOUBLE)", "self_check__overall_accuracy"),
             pick(s_ok, "hallucination_risk", "CAST(1.0 AS DOUBLE)", "self_check__hallucination_risk"),
             pick(s_ok, "approved", "FALSE", "self_check__approved"),
             pick(s_ok, "rejection_reason", null, "self_check__rejection_reason")]
    return f"SELECT {', '.join(cols)} FROM ({OUTCOME_SQL})"


def record(o):
    """The flat record of `record_sql` from nested results."""
    sizes = {"self_check__n_claims": F.size("self_check.verifications"),
             "normalized_input__n_pii": F.size("normalized_input.detected_pii").cast("long")}
    flat = W.flatten(o.withColumns(sizes))
    return flat.drop("self_check__verifications", "normalized_input__detected_pii")


@query("assemble_result", f"SELECT * FROM ({record_sql()}) WHERE success")
def assemble_result(spark, sf):
    return record(_outcome(spark, sf).filter("success"))


@query("error_result", f"SELECT * FROM ({record_sql()}) WHERE NOT success")
def error_result(spark, sf):
    return record(_outcome(spark, sf).filter(~F.col("success")))


@query("error_result_strict", f"SELECT * FROM ({record_sql(strict=True)}) WHERE NOT success")
def error_result_strict(spark, sf):
    return record(_outcome(spark, sf, strict=True).filter(~F.col("success")))


@query("export_flat", record_sql())
def export_flat(spark, sf):
    return record(_outcome(spark, sf))


@query("export_partitioned", f"SELECT run_id, success, error FROM ({record_sql()})")
def export_partitioned(spark, sf):
    """A10: results written in folders by outcome and read back."""
    path = ST.scratch(spark, "export")
    W.export(_outcome(spark, sf), path, partition_by=("success",))
    return spark.read.parquet(path).select("run_id", F.col("success").cast("boolean").alias("success"), "error")


STEP_DUR = "(epoch_us(completed_at) - epoch_us(started_at)) // 1000"


@query("step_duration", f"SELECT run_id, step, {STEP_DUR} AS duration_ms FROM fx_steps")
def step_duration(spark, sf):
    s = FX.fx_steps(spark, sf)
    return s.select("run_id", "step", W.step_duration_ms(F.col("started_at"), F.col("completed_at")).alias("duration_ms"))


@query("run_totals", f"""
SELECT run_id, {rsum('cost_usd')} AS total_cost_usd, CAST(sum(tokens_input) AS BIGINT) AS total_tokens_input,
  CAST(sum(tokens_output) AS BIGINT) AS total_tokens_output, CAST(sum({STEP_DUR}) AS BIGINT) AS total_latency_ms,
  count(*) AS n_steps,
  CASE WHEN bool_and(status = 'success') AND bool_and(approved) THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN NOT bool_and(status = 'success') THEN 'Provider timeout'
       WHEN NOT bool_and(approved) THEN 'Self-check did not approve extraction' END AS error
FROM (SELECT *, event_id % 10 < 7 OR step <> 'self_check' AS approved FROM fx_steps) GROUP BY run_id""")
def run_totals(spark, sf):
    s = FX.fx_steps(spark, sf)
    return W.run_totals(s.withColumns({
        "approved": (F.col("event_id") % 10 < 7) | (F.col("step") != "self_check"),
        "error": F.when(F.col("status") == "failed", F.lit("Provider timeout"))}))


@query("cost_by_step", f"""
SELECT step, rc AS cost_usd, round(l, 3) AS avg_latency_ms,
  c / CAST(sum(CAST(c AS DECIMAL(38,10))) OVER () AS DOUBLE) AS cost_share
FROM (SELECT step, {rsum('cost_usd')} AS rc, {xsum('cost_usd')} AS c, avg({STEP_DUR}) AS l FROM fx_steps GROUP BY step)""")
def cost_by_step(spark, sf):
    return W.cost_by_step(FX.fx_steps(spark, sf))


@query("run_ids", """
SELECT request_id, sha256(request_id || chr(1) || 'google' || chr(1) || 'gemini-2.5-flash-lite') AS run_id
FROM fx_feedback""")
def run_ids(spark, sf):
    """Deterministic run ids, stable across recomputation of a lost partition."""
    from .. import schemas as S
    from ..functions import keys
    f = FX.fx_feedback(spark, sf)
    return f.select("request_id", keys.run_id(F.col("request_id"), F.lit(S.DEFAULT_PROVIDER),
                                              F.lit(S.DEFAULT_MODEL)).alias("run_id"))
