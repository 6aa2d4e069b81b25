"""Flagship slice: cost and approval rate per provider over a batch of notes.

notes → validate (V1) → strip + redact (N1, P3) → extract prompt (B2) → self-check answers
(fixture text, plain or fenced) → salvage (J-1/J-2) → repair (R4) → gate (G1) → cost (C1)
→ per-provider totals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.exact import rsum
from ..operators import cost as C
from ..operators import ingest as I
from ..operators import prompts as P
from ..operators import repair as RP
from ..operators import responses as R
from ..sources import fixtures as FX
from .catalog import query
from .q_repair import SELF_CHECK_REPAIRED
from . import sql_snippets as Q

MODELS = {"openai": "gpt-4o-mini", "anthropic": "claude-sonnet-4-5", "google": S.DEFAULT_MODEL}


def cost_and_approval_by_provider(spark, sf):
    notes = I.accepted(FX.fx_feedback(spark, sf))
    prov = F.element_at(F.array(*[F.lit(p) for p in S.PROVIDERS]), (F.col("doc_id") % 3 + 1).cast("int"))
    model = F.coalesce(*[F.when(prov == p, F.lit(m)) for p, m in MODELS.items()])
    n = notes.select("request_id", "doc_id", prov.alias("provider"), model.alias("model"),
                     X.redact(X.strip_ws(F.col("content"))).alias("cleaned"))
    # the prompt's own words are a constant; blank lines keep them apart from the note's
    n_words = X.word_count(F.col("cleaned")) + X.word_count(P.extract_prompt(F.lit("")))
    n = n.withColumn("tokens_input", F.floor(n_words.cast("double") * F.lit(1.3)).cast("long")) \
         .withColumn("tokens_output", (F.lit(200) + F.col("doc_id") % 100).cast("long"))
    sc = FX.fx_self_check(spark, sf)
    answer = F.to_json(F.struct(*[f.name for f in S.SELF_CHECK.fields]))
    answer = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("Result:\n```json\n"), answer, F.lit("\n```"))) \
        .otherwise(answer)
    parsed = R.parse(sc.select("run_id", answer.alias("content")), "self_check")
    typed = parsed.select(F.col("run_id").alias("request_id"), "parsed.*")
    checked = RP.repair_self_check(typed).select("request_id", "approved")
    j = C.with_cost(n.join(checked, "request_id"))
    return j.groupBy("provider").agg(
        F.count(F.lit(1)).alias("notes"), F.sum(F.col("approved").cast("long")).alias("approved"),
        F.round(F.avg(F.col("approved").cast("double")), 6).alias("approval_rate"),
        rsum("cost_usd").alias("total_cost_usd"))


PROMPT_WORDS = Q.word_count(
    "'Pull structured insights out of this note:' || chr(10) || chr(10) || " + Q.redact(Q.strip("content"))
    + " || chr(10) || chr(10) || 'List the problem, current solution, pain points, value drivers, "
      "stakeholders, timeline and budget signals.'")


@query("flagship_cost_approval", f"""
WITH n AS (
  SELECT request_id, doc_id, CASE doc_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'google' END AS provider,
         CASE doc_id % 3 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'claude-sonnet-4-5' ELSE 'gemini-2.5-flash-lite' END AS model,
         CAST(floor({PROMPT_WORDS} * CAST(1.3 AS DOUBLE)) AS BIGINT) AS tokens_input,
         CAST(200 + doc_id % 100 AS BIGINT) AS tokens_output
  FROM fx_feedback WHERE content IS NOT NULL AND length(content) >= 10 AND {Q.strip('content')} <> ''),
c AS (
  SELECT n.provider, s.approved,
    CAST(round(CAST(n.tokens_input AS DECIMAL(18,0)) * CAST(p.price_in AS DECIMAL(12,6))
       + CAST(n.tokens_output AS DECIMAL(18,0)) * CAST(p.price_out AS DECIMAL(12,6)), 0) AS DOUBLE) / 1000000 AS cost_usd
  FROM n JOIN ({SELF_CHECK_REPAIRED}) s ON n.request_id = s.run_id
  JOIN (VALUES ('openai','gpt-4o-mini',0.15,0.60), ('anthropic','claude-sonnet-4-5',3.0,15.0),
               ('google','gemini-2.5-flash-lite',0.0375,0.15)) AS p(provider, model, price_in, price_out)
    ON n.provider = p.provider AND n.model = p.model)
SELECT provider, count(*) AS notes, CAST(sum(CASE WHEN approved THEN 1 ELSE 0 END) AS BIGINT) AS approved,
       round(avg(CASE WHEN approved THEN 1.0 ELSE 0.0 END), 6) AS approval_rate, {Q.rsum('cost_usd')} AS total_cost_usd
FROM c GROUP BY provider""")
def flagship_cost_approval(spark, sf):
    return cost_and_approval_by_provider(spark, sf)
