"""Queries for prompt tables (B1–B7), the model-call surface (M1) and attempts (M6, M7, M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import generate as G
from ..operators import prompts as P
from ..operators import repair as RP
from ..sources import fixtures as FX
from . import sql_snippets as Q
from .catalog import query
from .q_responses import cost_sql


def lit(s: str) -> str:
    """Python text → DuckDB string expression (newlines as chr(10))."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _cleaned(spark, sf):
    f = FX.fx_feedback(spark, sf)
    return f.select("request_id", "doc_id", "source", X.redact(X.strip_ws(F.col("content"))).alias("cleaned"))


CLEANED_SQL = f"SELECT request_id, doc_id, source, {Q.redact(Q.strip('content'))} AS cleaned FROM fx_feedback"


@query("prompt_ingest", f"""
SELECT request_id, 'ingest' AS step,
  {lit("Review this customer note and normalise it.\n\nNote: ")} || content || {lit("\nSource: ")} || source
  || {lit("\n\nReport the language, any personal data, a redacted copy and the word count.")} AS prompt,
  {lit(P.SYSTEM_PROMPTS['ingest'])} AS system_prompt
FROM fx_feedback""")
def prompt_ingest(spark, sf):
    f = FX.fx_feedback(spark, sf).select("request_id", F.lit("ingest").alias("step"),
                                         P.ingest_prompt(F.col("content"), F.col("source")).alias("prompt"),
                                         F.lit("google").alias("provider"))
    return P.with_system(f.withColumn("provider", F.lit("openai"))).select("request_id", "step", "prompt",
                                                                           "system_prompt")


EXTRACT_PROMPT_SQL = f"""
SELECT request_id, doc_id, source,
  {lit("Pull structured insights out of this note:\n\n")} || cleaned ||
  {lit("\n\nList the problem, current solution, pain points, value drivers, stakeholders, timeline and budget signals.")}
  AS prompt FROM ({CLEANED_SQL})"""


@query("prompt_extract", f"SELECT request_id, prompt FROM ({EXTRACT_PROMPT_SQL})")
def prompt_extract(spark, sf):
    c = _cleaned(spark, sf)
    return c.select("request_id", P.extract_prompt(F.col("cleaned")).alias("prompt"))


def _extracted(spark, sf):
    return RP.repair_extract(FX.fx_extracted(spark, sf))


EXTRACTED_JSON_SQL = """
SELECT run_id, doc_id, to_json(struct_pack(problem_statement := problem_statement, current_solution := NULL::VARCHAR,
  desired_outcome := desired_outcome, pain_points := pain_points, value_drivers := value_drivers,
  stakeholders := stakeholders, timeline := NULL::VARCHAR, budget_signals := NULL::VARCHAR,
  confidence_score := confidence_score)) AS ej
FROM (EXTRACT_REPAIRED_BODY)"""


def _ej_sql():
    from .q_repair import EXTRACT_REPAIRED
    return EXTRACTED_JSON_SQL.replace("EXTRACT_REPAIRED_BODY", EXTRACT_REPAIRED)


@query("prompt_self_check", f"""
SELECT e.run_id,
  {lit("Check this extraction against the note.\n\nNOTE:\n")} || c.cleaned || {lit("\n\nEXTRACTION:\n")} || e.ej
  || {lit("\n\nMark each claim as supported or not and rate the risk of invented facts.")} AS prompt
FROM ({_ej_sql()}) e JOIN ({CLEANED_SQL}) c ON e.run_id = c.request_id""")
def prompt_self_check(spark, sf):
    e = _extracted(spark, sf).select("run_id", P.extracted_json().alias("ej"))
    c = _cleaned(spark, sf)
    j = e.join(c, e.run_id == c.request_id)
    return j.select("run_id", P.self_check_prompt(F.col("cleaned"), F.col("ej")).alias("prompt"))


@query("prompt_rewrite", f"""
SELECT run_id,
  {lit("Write a value proposition from these checked insights:\n\n")} || ej || {lit("\n\nAudience: ")} ||
  CASE WHEN doc_id % 7 = 1 THEN {lit(P.PERSONA_LABELS['technical'])} ELSE {lit(P.PERSONA_LABELS['executive'])} END
  AS prompt
FROM ({_ej_sql()})""")
def prompt_rewrite(spark, sf):
    e = _extracted(spark, sf)
    persona = F.when(F.col("doc_id") % 7 == 1, F.lit("technical"))
    return e.select("run_id", P.rewrite_prompt(P.extracted_json(), persona).alias("prompt"))


def _with_schema(spark, sf):
    c = _cleaned(spark, sf)
    prov = F.element_at(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("google")),
                        (F.col("doc_id") % 3 + 1).cast("int"))
    p = c.select(F.col("request_id").alias("run_id"), F.lit("extract").alias("step"), prov.alias("provider"),
                 F.lit(None).cast("string").alias("model"), P.extract_prompt(F.col("cleaned")).alias("prompt"),
                 F.lit(2000).alias("max_tokens"))
    return P.with_system(p)


WITH_SCHEMA_SQL = f"""
SELECT request_id AS run_id, CASE doc_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'google' END AS provider,
  CASE WHEN doc_id % 3 = 0 THEN prompt
       ELSE prompt || {lit(P.SCHEMA_INTRO)} || {lit(P.schema_text('extract'))} END AS prompt,
  {lit(P.SYSTEM_PROMPTS['extract'])} AS system_prompt
FROM ({EXTRACT_PROMPT_SQL})"""


@query("prompt_with_schema", WITH_SCHEMA_SQL)
def prompt_with_schema(spark, sf):
    return _with_schema(spark, sf).select("run_id", "provider", "prompt", "system_prompt")


@query("cost_preview", cost_sql(f"""(SELECT run_id, provider, CAST(NULL AS VARCHAR) AS model,
    CAST(floor({Q.word_count('prompt')} * CAST(1.3 AS DOUBLE)) AS BIGINT) AS tokens_input,
    CAST(2000 AS BIGINT) AS tokens_output FROM ({WITH_SCHEMA_SQL}))""",
                                "s.run_id, s.tokens_input").replace("AS cost_usd", "AS cost_preview_usd"))
def cost_preview(spark, sf):
    return P.cost_preview(_with_schema(spark, sf)).select("run_id", "tokens_input", "cost_preview_usd")


@query("retry_select", """
SELECT run_id, attempt, error_kind, attempt + 1 AS next_attempt FROM fx_attempts
WHERE attempt = 1 AND NOT success AND error_kind NOT IN ('ValueError','TypeError','KeyError')
  AND NOT (event_id % 4 = 2)""")
def retry_select(spark, sf):
    r = G.retry_select(FX.fx_attempts(spark, sf))
    return r.select("run_id", "attempt", "error_kind", "next_attempt")


@query("retry_due", """
SELECT a.run_id, a.attempt + 1 AS next_attempt, r.completed_at + INTERVAL 4 SECOND AS due_at
FROM fx_attempts a JOIN fx_runs r ON a.run_id = r.run_id
WHERE a.attempt = 1 AND NOT a.success AND a.error_kind NOT IN ('ValueError','TypeError','KeyError')
  AND NOT (a.event_id % 4 = 2)""")
def retry_due(spark, sf):
    """M6: when each retry may start; a failed call ends with its run."""
    ended = FX.fx_runs(spark, sf).select("run_id", F.col("completed_at").alias("failed_at"))
    return G.retry_due(FX.fx_attempts(spark, sf).join(ended, "run_id")).select("run_id", "next_attempt", "due_at")


@query("attempt_latest", """
SELECT run_id, CASE WHEN NOT success AND event_id % 4 = 2 THEN 2 ELSE 1 END AS attempt,
       success OR event_id % 8 = 2 AS success
FROM fx_runs""")
def attempt_latest(spark, sf):
    return G.latest_attempt(FX.fx_attempts(spark, sf)).select("run_id", "attempt", "success")


NEXT_PROVIDER = {"openai": "anthropic", "anthropic": "google", "google": "openai"}


def fallback_attempts(spark, sf):
    a = FX.fx_attempts(spark, sf).withColumn("preference", F.lit(1))
    best = G.latest_attempt(a)
    failed = best.filter(~F.col("success"))
    nxt = F.coalesce(*[F.when(F.col("provider") == k, F.lit(v)) for k, v in NEXT_PROVIDER.items()])
    fb = failed.select("run_id", "event_id", nxt.alias("provider"), "model", "step", F.lit(1).alias("attempt"),
                       (F.col("event_id") % 5 != 0).alias("success"), F.lit(None).cast("string").alias("error_kind"),
                       F.lit(2).alias("preference"))
    return a.unionByName(fb)


@query("provider_fallback", """
SELECT run_id,
  CASE WHEN success OR (event_id % 4 = 2 AND event_id % 8 = 2) THEN provider
       ELSE CASE provider WHEN 'openai' THEN 'anthropic' WHEN 'anthropic' THEN 'google' ELSE 'openai' END END AS provider,
  CASE WHEN success OR (event_id % 4 = 2 AND event_id % 8 = 2) THEN 1 ELSE 2 END AS preference,
  CASE WHEN success THEN 1 WHEN event_id % 4 = 2 AND event_id % 8 = 2 THEN 2 ELSE 1 END AS attempt,
  success OR (event_id % 4 = 2 AND event_id % 8 = 2) OR event_id % 5 <> 0 AS success
FROM fx_runs""")
def provider_fallback(spark, sf):
    return G.provider_fallback(fallback_attempts(spark, sf)).select("run_id", "provider", "preference",
                                                                    "attempt", "success")


@query("provider_unconfigured", """
SELECT run_id, provider, 'provider_not_configured' AS reject_reason FROM fx_runs
WHERE provider NOT IN ('openai', 'google')""")
def provider_unconfigured(spark, sf):
    r = FX.fx_runs(spark, sf).select("run_id", "provider")
    return G.unconfigured(r, ["openai", "google"]).select("run_id", "provider", "reject_reason")
