"""The fixture views of `sources/fixtures.py`, written once more in DuckDB SQL for the oracle."""

from __future__ import annotations

import re

PAD4 = "lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')"
KEY = ("'workflow:result:' || sha256({c} || ':' || {p} || ':' || {m})")

FX: dict[str, str] = {}

FX["fx_feedback"] = """
SELECT CAST(doc_id AS VARCHAR) AS request_id, doc_id, text AS content, source,
       'cust-' || CAST(doc_id % 100 AS VARCHAR) AS customer_id, lang,
       make_timestamp((1704067200 + doc_id * 60) * 1000000) AS requested_at
FROM documents"""

FX["fx_conversation_notes"] = """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content
FROM conversations WHERE role = 'user' GROUP BY conv_id"""

FX["fx_pii"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS request_id, doc_id,
       text || CASE doc_id % 5
         WHEN 0 THEN ' Reach me at jane.doe' || CAST(doc_id AS VARCHAR) || '@example.com today.'
         WHEN 1 THEN ' Call +1 (555) 555-' || {PAD4} || ' after 5pm.'
         WHEN 2 THEN ' SSN 123-45-' || {PAD4} || '.'
         WHEN 3 THEN ' Card ' || CASE WHEN doc_id % 2 = 0 THEN '4111 1111 1111 1111'
                                      ELSE '4111 1111 1111 1112' END || ' on file.'
         ELSE '' END AS content
FROM documents"""

FX["fx_response_fields"] = """
SELECT doc_id, text AS problem_statement,
       'Outcome for ' || source AS desired_outcome,
       ['pain ' || lang, 'cost ' || source] AS pain_points,
       CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence_score
FROM documents"""

# typed fixtures: the oracle states the same values directly
FX["fx_extracted"] = """
SELECT CAST(doc_id AS VARCHAR) AS run_id, doc_id,
       CASE WHEN doc_id % 7 = 3 THEN '' ELSE text END AS problem_statement,
       CAST(NULL AS VARCHAR) AS current_solution,
       CASE WHEN doc_id % 7 = 5 THEN NULL ELSE 'Outcome ' || source END AS desired_outcome,
       CASE doc_id % 7 WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN CAST(NULL AS VARCHAR[])
            WHEN 6 THEN ['slow rollout', '  '] ELSE ['slow ' || lang, ' manual work '] END AS pain_points,
       CASE WHEN doc_id % 7 = 2 THEN CAST([] AS VARCHAR[]) ELSE ['time', 'cost'] END AS value_drivers,
       CASE WHEN doc_id % 7 = 4 THEN CAST(NULL AS VARCHAR[]) ELSE ['cfo'] END AS stakeholders,
       CAST(NULL AS VARCHAR) AS timeline, CAST(NULL AS VARCHAR) AS budget_signals,
       CASE doc_id % 7 WHEN 4 THEN NULL WHEN 6 THEN 1.5
            ELSE CAST(doc_id % 10 AS DOUBLE) / 10 END AS confidence_score
FROM documents"""

FX["fx_self_check"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS run_id, d.doc_id,
       CASE d.doc_id % 7 WHEN 1 THEN -1 WHEN 5 THEN 2 ELSE 1 END AS n_claims,
       CASE WHEN d.doc_id % 7 = 5 THEN CASE WHEN d.doc_id % 2 = 0 THEN 2 ELSE 1 END
            WHEN d.doc_id % 7 = 1 THEN 0 ELSE 1 END AS n_supported,
       CASE d.doc_id % 7 WHEN 2 THEN NULL WHEN 4 THEN 1.2
            ELSE CAST(d.doc_id % 5 + 6 AS DOUBLE) / 10 END AS overall_accuracy,
       CAST(l.toxic AS DOUBLE) * 0.5 + 0.1 AS hallucination_risk,
       CASE WHEN d.doc_id % 7 = 6 THEN NULL ELSE l.quality = 1 END AS approved,
       CASE WHEN d.doc_id % 7 IN (3, 6) THEN NULL
            WHEN l.quality = 1 THEN NULL ELSE 'Claims not supported' END AS rejection_reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

FX["fx_value_prop"] = """
SELECT CAST(doc_id AS VARCHAR) AS run_id, doc_id,
       CASE doc_id % 7 WHEN 4 THEN '' WHEN 5 THEN rpad('H', 201, 'x')
            ELSE CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Less manual work for ' || source END END AS headline,
       'Problem of ' || source AS problem, 'Automate the workflow' AS solution,
       CASE WHEN doc_id % 7 = 2 THEN NULL ELSE 'Faster than manual' END AS differentiation,
       CAST(NULL AS VARCHAR) AS quantified_value,
       CASE WHEN doc_id % 7 = 6 THEN '   ' ELSE 'Book a demo' END AS call_to_action,
       CASE WHEN doc_id % 7 = 1 THEN 'technical' ELSE NULL END AS persona,
       CASE doc_id % 7 WHEN 0 THEN ['p1'] WHEN 1 THEN ['p1','p2','p3']
            WHEN 2 THEN ['p1','p2','p3','p4','p5','p6'] WHEN 3 THEN CAST(NULL AS VARCHAR[])
            WHEN 4 THEN ['p1','p2','p3','p4'] WHEN 5 THEN ['p1','p2']
            ELSE ['p1','p2','p3','p4','p5'] END AS key_talking_points
FROM documents"""

FX["fx_runs"] = """
SELECT CAST(event_id AS VARCHAR) AS run_id, event_id,
       started_at,
       make_timestamp(epoch_us(started_at) + CAST(round(value * 100000) AS BIGINT)) AS completed_at,
       user_id, event_id // 3 AS input_key, 'cust-' || CAST(user_id AS VARCHAR) AS customer_id,
       CASE user_id % 4 WHEN 0 THEN 'crm' WHEN 1 THEN 'email' WHEN 2 THEN 'call' ELSE 'manual' END AS source,
       CASE event_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'google' END AS provider,
       CASE event_id % 3 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'claude-sonnet-4-5'
            ELSE 'gemini-2.5-flash-lite' END AS model,
       event_type <> 'error' AS success, event_type = 'error' AND event_id % 5 <> 0 AS raised,
       event_id % 10 < 7 AS approved,
       CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'staging' ELSE 'prod' END AS environment,
       event_type = 'view' AS from_cache,
       value, value / 10 AS duration_s, CAST(round(value * 100) AS BIGINT) AS duration_ms,
       value / 10000 AS cost_usd,
       100 + (event_id * 37) % 900 AS tokens_input, 50 + (event_id * 13) % 450 AS tokens_output,
       CAST(event_id % 5 + 6 AS DOUBLE) / 10 AS accuracy, CAST(event_id % 10 AS DOUBLE) / 10 AS risk,
       CASE WHEN event_type = 'error' THEN 'Provider timeout' END AS error
FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN date_trunc('second', CAST(ts AS TIMESTAMP))
                     ELSE CAST(ts AS TIMESTAMP) END AS started_at FROM events)"""

FX["fx_steps"] = """
SELECT r.run_id, r.event_id, r.provider, r.model, s.step, s.idx AS step_idx,
       CASE WHEN NOT r.success AND s.idx = r.event_id % 4 THEN 'failed' ELSE 'success' END AS status,
       make_timestamp(epoch_us(r.started_at) + CAST(round(r.value * s.cum * 1000) AS BIGINT)) AS started_at,
       make_timestamp(epoch_us(r.started_at) + CAST(round(r.value * s.cum * 1000) AS BIGINT)
                      + CAST(round(r.value * s.w * 1000) AS BIGINT)) AS completed_at,
       (r.tokens_input * s.w) // 100 AS tokens_input,
       (r.tokens_output * s.w) // 100 AS tokens_output,
       r.value * s.w / CAST(1000000 AS DOUBLE) AS cost_usd
FROM fx_runs r,
     (VALUES ('ingest', 0, 10, 0), ('extract', 1, 30, 10), ('self_check', 2, 20, 40),
             ('rewrite', 3, 40, 60)) AS s(step, idx, w, cum)
WHERE r.success OR s.idx <= r.event_id % 4"""

# the log, stated as parsed rows (the oracle parses no JSON)
FX["fx_log"] = f"""
SELECT 'workflow_execution_started' AS event, 'info' AS level, started_at AS ts, run_id, provider,
       model, source, CAST(NULL AS BOOLEAN) AS success, CAST(NULL AS DOUBLE) AS total_cost_usd,
       CAST(NULL AS BIGINT) AS total_latency_ms, CAST(NULL AS VARCHAR) AS error,
       CAST(NULL AS VARCHAR) AS cache_key, CAST(NULL AS VARCHAR) AS field
FROM fx_runs
UNION ALL
SELECT CASE WHEN from_cache THEN 'cache_hit' ELSE 'cache_miss' END, 'info', started_at, run_id,
       provider, model, source, NULL, NULL, NULL, NULL, {KEY.format(c='run_id', p='provider', m='model')}, NULL
FROM fx_runs
UNION ALL
SELECT 'workflow_execution_completed', 'info', completed_at, run_id, provider, model, source, success,
       cost_usd, duration_ms, NULL, NULL, NULL
FROM fx_runs WHERE NOT raised
UNION ALL
SELECT 'workflow_execution_failed', 'error', completed_at, run_id, provider, model, source, NULL,
       NULL, NULL, error, NULL, NULL
FROM fx_runs WHERE raised
UNION ALL
SELECT 'extraction_missing_field', 'warning', completed_at, run_id, provider, model, source, NULL,
       NULL, NULL, NULL, NULL, 'pain_points'
FROM fx_runs WHERE event_id % 7 = 0
UNION ALL
SELECT 'google_token_count_estimated', 'warning', completed_at, run_id, provider, model, source,
       NULL, NULL, NULL, NULL, NULL, 'tokens_input'
FROM fx_runs WHERE event_id % 11 = 0 AND provider = 'google'"""

FX["fx_cache"] = f"""
SELECT {KEY.format(c='content', p="'google'", m="'gemini-2.5-flash-lite'")} AS cache_key,
       'cached-' || CAST(doc_id AS VARCHAR) || '-' || CAST(version AS VARCHAR) AS cached_run_id,
       CAST(doc_id % 50 + version AS DOUBLE) / 10000 AS cached_cost_usd,
       written_at
FROM (SELECT doc_id, content, requested_at AS written_at, 0 AS version FROM fx_feedback WHERE doc_id % 3 = 0
      UNION ALL
      SELECT doc_id, content, requested_at + INTERVAL 30 MINUTE, 1 FROM fx_feedback WHERE doc_id % 9 = 0)"""

FX["fx_attempts"] = """
SELECT run_id, event_id, provider, model, 'extract' AS step, 1 AS attempt, success,
       CASE WHEN NOT success THEN CASE event_id % 4 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'TypeError'
            WHEN 2 THEN 'TimeoutError' ELSE 'RateLimitError' END END AS error_kind
FROM fx_runs
UNION ALL
SELECT run_id, event_id, provider, model, 'extract', 2, event_id % 8 = 2,
       CASE WHEN event_id % 8 = 2 THEN NULL ELSE 'TimeoutError' END
FROM fx_runs WHERE NOT success AND event_id % 4 = 2"""


def with_fx(body: str) -> str:
    """Prefix `body` with the fixture CTEs it uses (and the ones those use)."""
    order = list(FX)
    need: set[str] = set()

    def visit(sql: str) -> None:
        for name in order:
            if name not in need and re.search(rf"\b{name}\b", sql):
                need.add(name)
                visit(FX[name])

    visit(body)
    ctes = [f"{n} AS ({FX[n]})" for n in order if n in need]
    if not ctes:
        return body
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
