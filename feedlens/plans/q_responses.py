"""Queries for the response envelope (M2–M5), cost (C1) and JSON salvage (J-1 … J-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsonsalvage import brace_objects as brace_objects_expr
from ..operators import cost as C
from ..operators import responses as R
from ..sources import fixtures as FX
from .catalog import query


def fx_envelopes(spark, sf):
    r = FX.fx_runs(spark, sf)
    even = F.col("event_id") % 2 == 0
    text = F.concat(F.lit("answer "), F.col("run_id"), F.lit(" ok"))
    bare = F.col("event_id") % 12 == 0  # a call without arguments
    openai_fc = F.struct(
        F.struct(F.struct(F.lit("f").alias("name"),
                          F.when(~bare, F.concat(F.lit('{"k": '), F.col("run_id"), F.lit("}"))).alias("arguments"))
                 .alias("function_call")).alias("additional_kwargs"),
        F.struct(F.struct(F.col("tokens_input").alias("prompt_tokens"),
                          F.col("tokens_output").alias("completion_tokens")).alias("token_usage"),
                 F.lit("length").alias("finish_reason")).alias("response_metadata"))
    openai_tool = F.struct(
        F.array(F.struct(F.struct(F.col("event_id").alias("k")).alias("args"))).alias("tool_calls"),
        F.struct(F.struct(F.col("tokens_input").alias("prompt_tokens"),
                          F.col("tokens_output").alias("completion_tokens")).alias("token_usage"))
        .alias("response_metadata"))
    anthropic = F.struct(
        text.alias("content"),
        F.when(F.col("event_id") % 4 == 0, F.array(F.struct(F.struct(F.lit("ignored").alias("k")).alias("args"))))
        .alias("tool_calls"),  # only OpenAI's tool calls carry the answer
        F.struct(F.struct(F.when(F.col("event_id") % 10 == 1, F.lit("n/a"))
                          .when(F.col("event_id") % 10 == 3, F.concat(F.col("tokens_input").cast("string"), F.lit(".0")))
                          .otherwise(F.col("tokens_input").cast("string")).alias("input_tokens"),
                          F.col("tokens_output").alias("output_tokens")).alias("usage"),
                 F.when(even, F.lit("max_tokens")).alias("stop_reason")).alias("response_metadata"))
    zero = F.col("event_id") % 5 == 0
    google = F.struct(
        text.alias("content"),
        F.struct(F.struct(F.when(zero, F.lit(0)).otherwise(F.col("tokens_input")).alias("prompt_token_count"),
                          F.when(zero, F.lit(0)).otherwise(F.col("tokens_output")).alias("candidates_token_count"))
                 .alias("usage_metadata"),
                 F.when(even, F.lit("STOP")).alias("finish_reason")).alias("response_metadata"))
    env = (F.when((F.col("provider") == "openai") & even, F.to_json(openai_fc))
           .when(F.col("provider") == "openai", F.to_json(openai_tool))
           .when(F.col("provider") == "anthropic", F.to_json(anthropic))
           .otherwise(F.to_json(google)))
    prompt = F.concat(F.lit("Extract insights from note "), F.col("run_id"), F.lit(" about "), F.col("source"))
    return r.select("run_id", "event_id", "provider", "model", env.alias("envelope"), prompt.alias("prompt"))


ENVELOPE_EXPECT = """
SELECT run_id,
  CASE WHEN provider = 'openai' AND event_id % 12 = 0 THEN '{}'
       WHEN provider = 'openai' AND event_id % 2 = 0 THEN '{"k": ' || run_id || '}'
       WHEN provider = 'openai' THEN '{"k":' || CAST(event_id AS VARCHAR) || '}'
       ELSE 'answer ' || run_id || ' ok' END AS content,
  CASE WHEN provider = 'google' AND event_id % 5 = 0 THEN 9
       WHEN provider = 'anthropic' AND event_id % 10 = 1 THEN 0 ELSE tokens_input END AS tokens_input,
  provider = 'anthropic' AND event_id % 10 = 1 AS tokens_unreadable,
  CASE WHEN provider = 'google' AND event_id % 5 = 0 THEN 3 ELSE tokens_output END AS tokens_output,
  provider = 'google' AND event_id % 5 = 0 AS tokens_estimated,
  CASE WHEN provider = 'openai' AND event_id % 2 = 0 THEN 'length'
       WHEN provider = 'openai' THEN 'stop'
       WHEN provider = 'anthropic' AND event_id % 2 = 0 THEN 'max_tokens'
       WHEN provider = 'anthropic' THEN 'end_turn'
       WHEN event_id % 2 = 0 THEN 'STOP' ELSE 'stop' END AS finish_reason
FROM fx_runs"""


@query("response_content", f"SELECT run_id, content FROM ({ENVELOPE_EXPECT})")
def response_content(spark, sf):
    return R.unpack_envelope(fx_envelopes(spark, sf)).select("run_id", "content")


@query("response_tokens", f"""
SELECT run_id, tokens_input, tokens_output, tokens_unreadable, finish_reason FROM ({ENVELOPE_EXPECT})""")
def response_tokens(spark, sf):
    return R.unpack_envelope(fx_envelopes(spark, sf)).select(
        "run_id", "tokens_input", "tokens_output", "tokens_unreadable", "finish_reason")


@query("token_estimate", f"""
SELECT run_id, tokens_input, tokens_output FROM ({ENVELOPE_EXPECT}) WHERE tokens_estimated""")
def token_estimate(spark, sf):
    u = R.unpack_envelope(fx_envelopes(spark, sf))
    return u.filter("tokens_estimated").select("run_id", "tokens_input", "tokens_output")


PRICES_SQL = """
(VALUES ('openai','gpt-4o-mini',0.15,0.60), ('openai','gpt-4o',2.50,10.00),
        ('anthropic','claude-sonnet-4-5',3.0,15.0), ('google','gemini-2.5-flash',0.075,0.3),
        ('google','gemini-2.5-flash-lite',0.0375,0.15), ('google','gemini-2.5-pro',1.25,5.0))
  AS p(provider, model, price_in, price_out)"""
DEFAULTS_SQL = """
(VALUES ('openai',2.50,10.0), ('anthropic',3.0,15.0), ('google',0.5,1.5)) AS dp(provider, default_in, default_out)"""


def cost_sql(src: str, cols: str) -> str:
    return f"""
SELECT {cols},
  CAST(round(CAST(s.tokens_input AS DECIMAL(18,0)) * CAST(coalesce(p.price_in, dp.default_in) AS DECIMAL(12,6))
       + CAST(s.tokens_output AS DECIMAL(18,0)) * CAST(coalesce(p.price_out, dp.default_out) AS DECIMAL(12,6)), 0)
       AS DOUBLE) / 1000000 AS cost_usd
FROM {src} s LEFT JOIN {PRICES_SQL} ON s.provider = p.provider AND s.model = p.model
LEFT JOIN {DEFAULTS_SQL} ON s.provider = dp.provider"""


STEP_MODELS = """(SELECT run_id, step, provider,
    CASE WHEN event_id % 10 = 9 THEN model || '-preview' ELSE model END AS model,
    tokens_input, tokens_output FROM fx_steps)"""


@query("step_cost", cost_sql(STEP_MODELS, "s.run_id, s.step, s.model"))
def step_cost(spark, sf):
    s = FX.fx_steps(spark, sf).withColumn(
        "model", F.when(F.col("event_id") % 10 == 9, F.concat("model", F.lit("-preview"))).otherwise(F.col("model")))
    return C.with_cost(s).select("run_id", "step", "model", "cost_usd")


@query("price_dimension", f"""
SELECT s.provider, s.model, CAST(coalesce(p.price_in, dp.default_in) AS DOUBLE) AS price_in,
  CAST(coalesce(p.price_out, dp.default_out) AS DOUBLE) AS price_out, p.model IS NOT NULL AS listed,
  CASE WHEN s.provider = 'openai' THEN contains(s.model, 'gpt-4') OR contains(s.model, 'gpt-3.5') ELSE FALSE END
    AS supports_json_mode,
  CASE WHEN s.provider = 'anthropic' THEN contains(s.model, 'claude-3') ELSE TRUE END AS supports_function_calling,
  s.n_steps
FROM (SELECT provider, model, count(*) AS n_steps FROM {STEP_MODELS} GROUP BY 1, 2) s
LEFT JOIN {PRICES_SQL} ON s.provider = p.provider AND s.model = p.model
LEFT JOIN {DEFAULTS_SQL} ON s.provider = dp.provider""")
def price_dimension(spark, sf):
    """A3/M8: prices and capability flags of every model seen in the step log (listed or not)."""
    s = FX.fx_steps(spark, sf).withColumn(
        "model", F.when(F.col("event_id") % 10 == 9, F.concat("model", F.lit("-preview"))).otherwise(F.col("model")))
    return C.model_catalog(s.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n_steps")))


# ---- JSON salvage over eight answer shapes ----------------------------------------------

def _parsed(spark, sf):
    p = R.parse(FX.fx_responses(spark, sf), "extract")
    return p.select("doc_id", "strategy", F.col("parsed.problem_statement").alias("problem_statement"),
                    F.col("parsed.desired_outcome").alias("desired_outcome"),
                    F.array_join("parsed.pain_points", "|").alias("pain_points"),
                    F.col("parsed.confidence_score").alias("confidence_score"), "n_keys", "content")


EXPECT = """
SELECT doc_id,
  CASE doc_id % 8 WHEN 0 THEN 'direct' WHEN 1 THEN 'fenced' WHEN 2 THEN 'open_fence' WHEN 3 THEN 'longest'
       WHEN 4 THEN 'first' WHEN 5 THEN 'cleaned' WHEN 6 THEN 'regex' ELSE 'rejected' END AS strategy,
  CASE WHEN doc_id % 8 <> 7 THEN problem_statement END AS problem_statement,
  CASE WHEN doc_id % 8 NOT IN (4, 7) THEN desired_outcome END AS desired_outcome,
  CASE WHEN doc_id % 8 NOT IN (4, 7) THEN array_to_string(pain_points, '|') END AS pain_points,
  CASE WHEN doc_id % 8 <> 7 THEN confidence_score END AS confidence_score,
  CASE doc_id % 8 WHEN 4 THEN 2 WHEN 7 THEN NULL ELSE 4 END AS n_keys
FROM fx_response_fields"""

for _name, _strategy in [("parse_direct", "direct"), ("parse_fenced", "fenced"),
                         ("parse_open_fence", "open_fence"), ("parse_longest", "longest"),
                         ("parse_first", "first"), ("parse_cleaned", "cleaned"), ("parse_regex", "regex")]:
    def _make(strategy):
        def fn(spark, sf):
            return _parsed(spark, sf).filter(F.col("strategy") == strategy).drop("content")
        return fn
    query(_name, f"SELECT * FROM ({EXPECT}) WHERE strategy = '{_strategy}'")(_make(_strategy))


@query("parse_rejects", """
SELECT doc_id, 'unparseable_json' AS reason,
       substr('No structured answer for ' || source || '.', 1, 500) AS preview
FROM documents WHERE doc_id % 8 = 7""")
def parse_rejects(spark, sf):
    p = _parsed(spark, sf)
    return R.parse_rejects(p).select("doc_id", "reason", "preview")


@query("parse_report", f"""
SELECT strategy, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM ({EXPECT}) GROUP BY strategy""")
def parse_report(spark, sf):
    return R.parse_report(_parsed(spark, sf))


@query("brace_objects", """
SELECT doc_id, CASE doc_id % 8 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END AS n_objects
FROM documents""")
def brace_objects(spark, sf):
    r = FX.fx_responses(spark, sf)
    return r.select("doc_id", F.size(brace_objects_expr(F.col("content"))).alias("n_objects"))


def fx_many_objects(spark, sf):
    """Answers with as many inner objects as the document has characters, by doc_id % 4: no JSON at all, one level
    that is nested once, a good object after stray ones, and openings that never close."""
    from ..sources.tables import table
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    k, n = F.col("doc_id") % 4, F.col("n_chars").cast("int")
    inner = F.expr("repeat('{x} ', cast(n_chars as int))")
    good = F.lit('{"problem_statement": "p", "desired_outcome": "o", "confidence_score": 0.5}')
    text = (F.when(k == 0, F.concat(F.lit("{"), inner, F.lit("}")))
            .when(k == 1, F.concat(F.lit("{"), good, inner))
            .when(k == 2, F.concat(F.lit("} "), inner, good))
            .otherwise(F.concat(F.repeat(F.lit("{"), n), F.lit("a}"), F.lit("```json {"), inner)))
    return d.select("doc_id", text.alias("content"))


@query("parse_many_objects", """
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'regex' WHEN doc_id % 4 = 2 THEN 'longest'
       WHEN doc_id % 4 = 0 AND n_chars = 0 THEN 'direct' ELSE 'rejected' END AS strategy,
  CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN n_chars + 1 ELSE CASE WHEN n_chars = 1 THEN 1 ELSE 0 END END
    AS n_objects,
  CASE WHEN doc_id % 4 IN (1, 2) THEN 'p' END AS problem_statement
FROM documents""")
def parse_many_objects(spark, sf):
    """J-3 to J-9 over answers of many thousand objects: linear in the answer, whatever its braces."""
    p = R.parse(fx_many_objects(spark, sf), "extract")
    return p.select("doc_id", "strategy", F.size(brace_objects_expr(F.col("content"))).cast("long").alias("n_objects"),
                    F.col("parsed.problem_statement").alias("problem_statement"))


def fx_typed_answers(spark, sf):
    """Extract answers where some fields carry the wrong JSON type (by doc_id % 4)."""
    from ..sources.tables import table
    d = table(spark, sf, "documents").select("doc_id", "source")
    k = F.col("doc_id") % 4
    conf = F.when(k == 0, F.lit('"high"')).otherwise(F.lit("0.7"))
    pains = F.when(k == 1, F.lit('"slow"')).otherwise(F.lit('["slow"]'))
    text = F.concat(F.lit('{"problem_statement": "p", "desired_outcome": "o", "pain_points": '), pains,
                    F.lit(', "value_drivers": ["time"], "confidence_score": '), conf,
                    F.when(k == 2, F.lit(', "stakeholders": {"a": 1}')).otherwise(F.lit("")), F.lit("}"))
    return d.select(F.col("doc_id").cast("string").alias("run_id"), text.alias("content"))


@query("parse_type_errors", """
SELECT CAST(doc_id AS VARCHAR) AS run_id,
  CASE doc_id % 4 WHEN 0 THEN 'type:confidence_score' WHEN 1 THEN 'type:pain_points'
       WHEN 2 THEN 'type:stakeholders' ELSE '' END AS type_errors,
  doc_id % 4 = 3 AS valid
FROM documents""")
def parse_type_errors(spark, sf):
    from ..operators import repair as RP
    p = R.parse(fx_typed_answers(spark, sf), "extract")
    typed = p.select("run_id", "type_errors", "parsed.*")
    c = RP.conform_extract(RP.repair_extract(typed))
    return c.select("run_id", F.array_join("type_errors", ",").alias("type_errors"), "valid")
