"""Queries for sources A1/A2, validation V1, normalisation N1–N5 and PII P1–P5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ingest as I
from ..operators import pii_model as M
from ..sources import fixtures as FX
from ..sources.tables import table
from . import sql_snippets as Q
from .catalog import query


@query("scan_feedback", """
SELECT request_id, source, customer_id, 'google' AS provider, 'gemini-2.5-flash-lite' AS model,
       CAST(0.7 AS DOUBLE) AS temperature, 'executive' AS persona, length(content) AS n_chars
FROM fx_feedback""")
def scan_feedback(spark, sf):
    f = I.fill_defaults(FX.fx_feedback(spark, sf).drop("doc_id", "lang", "requested_at"))
    return f.select("request_id", "source", "customer_id", "provider", "model", "temperature",
                    "persona", F.length("content").alias("n_chars"))


@query("conversation_notes", """
SELECT conv_id, content, length(content) AS n_chars FROM fx_conversation_notes""")
def conversation_notes(spark, sf):
    c = FX.fx_conversation_notes(spark, sf)
    return c.select("conv_id", "content", F.length("content").alias("n_chars"))


@query("validate_input", f"""
SELECT request_id,
       CASE WHEN content IS NULL THEN 'missing_content' WHEN length(content) < 10 THEN 'too_short'
            WHEN {Q.strip('content')} = '' THEN 'blank' END AS reject_reason
FROM fx_feedback""")
def validate_input(spark, sf):
    return I.validate(FX.fx_feedback(spark, sf)).select("request_id", "reject_reason")


@query("validate_rejects", f"""
SELECT request_id, reject_reason FROM (
SELECT request_id,
       CASE WHEN content IS NULL THEN 'missing_content' WHEN length(content) < 10 THEN 'too_short'
            WHEN {Q.strip('content')} = '' THEN 'blank' END AS reject_reason
FROM fx_feedback) WHERE reject_reason IS NOT NULL""")
def validate_rejects(spark, sf):
    return I.rejects(FX.fx_feedback(spark, sf)).select("request_id", "reject_reason")


@query("normalize_text", f"""
SELECT request_id, {Q.strip('content')} AS content, length({Q.strip('content')}) AS n_chars
FROM fx_feedback""")
def normalize_text(spark, sf):
    f = FX.fx_feedback(spark, sf)
    s = X.strip_ws(F.col("content"))
    return f.select("request_id", s.alias("content"), F.length(s).alias("n_chars"))


@query("word_count", f"""
SELECT request_id, {Q.word_count('content')} AS word_count FROM fx_feedback
UNION ALL
SELECT 'conv-' || CAST(conv_id AS VARCHAR), {Q.word_count('content')} FROM fx_conversation_notes""")
def word_count(spark, sf):
    f = FX.fx_feedback(spark, sf).select("request_id", "content")
    c = FX.fx_conversation_notes(spark, sf).select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("request_id"), "content")
    both = f.unionByName(c)
    return both.select("request_id", X.word_count(F.col("content")).alias("word_count"))


@query("language_norm", """
SELECT request_id, CASE WHEN lower(lang) IN ('en','es','fr','de') THEN lower(lang) ELSE 'other' END
       AS language FROM fx_feedback""")
def language_norm(spark, sf):
    return FX.fx_feedback(spark, sf).select("request_id", X.language(F.col("lang")).alias("language"))


@query("language_mix", """
SELECT CASE WHEN lower(lang) IN ('en','es','fr','de') THEN lower(lang) ELSE 'other' END AS language,
       count(*) AS n FROM fx_feedback GROUP BY 1""")
def language_mix(spark, sf):
    f = FX.fx_feedback(spark, sf).select(X.language(F.col("lang")).alias("language"))
    return I.language_mix(f)


@query("pii_spans", Q.pii_rows("fx_pii"))
def pii_spans(spark, sf):
    return I.pii_table(FX.fx_pii(spark, sf))


@query("pii_spans_documents", Q.pii_rows(
    "(SELECT CAST(doc_id AS VARCHAR) AS request_id, text AS content FROM documents)"))
def pii_spans_documents(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("request_id"),
                                            F.col("text").alias("content"))
    return I.pii_table(d)


@query("pii_redact", f"""
SELECT request_id, {Q.redact('content')} AS cleaned_content FROM fx_pii""")
def pii_redact(spark, sf):
    return FX.fx_pii(spark, sf).select("request_id", X.redact(F.col("content")).alias("cleaned_content"))


@query("pii_flag", f"""
SELECT p.request_id, coalesce(n, 0) > 0 AS has_pii, coalesce(n, 0) AS n_pii
FROM fx_pii p LEFT JOIN (SELECT request_id, count(*) AS n FROM ({Q.pii_rows('fx_pii')}) GROUP BY 1) d
  ON p.request_id = d.request_id""")
def pii_flag(spark, sf):
    n = I.normalize(FX.fx_pii(spark, sf))
    return n.select("request_id", "has_pii", F.size("detected_pii").alias("n_pii"))


@query("pii_by_type", f"""
SELECT pii_type, count(*) AS n FROM ({Q.pii_rows('fx_pii')}) GROUP BY 1""")
def pii_by_type(spark, sf):
    return I.pii_by_type(FX.fx_pii(spark, sf))


def fx_ingest_responses(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    k = F.col("doc_id") % 4
    zh = F.to_json(F.struct(F.lit("zh").alias("language"), F.lit(True).alias("pii_detected"),
                            F.concat(F.lit("leaks jane.doe@example.com "), F.col("doc_id").cast("string"))
                            .alias("redacted_text"), F.lit(7).alias("word_count")))
    good = F.to_json(F.struct(F.concat(F.lit(" "), F.upper("lang"), F.lit("\n")).alias("language"), F.lit(False).alias("pii_detected"),
                              F.concat(F.lit("clean "), F.col("doc_id").cast("string")).alias("redacted_text"),
                              (F.col("doc_id") % 50).alias("word_count"),
                              F.lit("good").alias("input_quality")))
    text = F.when(k == 1, zh).when(k == 2, F.lit("garbage answer")).otherwise(good)
    return d.filter(k != 0).select(F.col("doc_id").cast("string").alias("request_id"),
                                   text.alias("content"))


@query("ingest_merge", f"""
WITH det AS (SELECT request_id, count(*) AS n FROM ({Q.pii_rows('fx_pii')}) GROUP BY 1)
SELECT p.request_id,
       CASE p.doc_id % 4 WHEN 1 THEN 'other' WHEN 3 THEN d.lang ELSE 'en' END AS language,
       coalesce(det.n, 0) > 0 OR p.doc_id % 4 = 1 AS has_pii,
       CASE p.doc_id % 4 WHEN 1 THEN 'leaks [REDACTED] ' || CAST(p.doc_id AS VARCHAR)
            WHEN 3 THEN 'clean ' || CAST(p.doc_id AS VARCHAR)
            ELSE {Q.redact(Q.strip('p.content'))} END AS cleaned_content,
       CASE p.doc_id % 4 WHEN 1 THEN 7 WHEN 3 THEN p.doc_id % 50
            ELSE {Q.word_count('p.content')} END AS word_count,
       CASE WHEN p.doc_id % 4 = 3 THEN 'good' END AS input_quality,
       CASE p.doc_id % 4 WHEN 0 THEN 'no_answer' WHEN 2 THEN 'fallback' ELSE 'model' END AS ingest_source
FROM fx_pii p JOIN documents d ON p.doc_id = d.doc_id LEFT JOIN det ON p.request_id = det.request_id""")
def ingest_merge(spark, sf):
    notes = FX.fx_pii(spark, sf).select("request_id", "content")
    m = I.merge_ingest(notes, fx_ingest_responses(spark, sf))
    return m.select("request_id", "language", "has_pii", "cleaned_content",
                    F.col("word_count").cast("long").alias("word_count"), "input_quality",
                    "ingest_source")


@query("workflow_rejects", """
SELECT request_id, reason AS reject_reason FROM (
  SELECT request_id, CASE WHEN content IS NULL THEN 'missing_content' WHEN length(content) < 10 THEN 'too_short'
      WHEN """ + Q.strip("content") + """ = '' THEN 'blank'
      WHEN doc_id % 25 > 20 AND doc_id % 4 = 3 THEN 'temperature_range,provider_enum'
      WHEN doc_id % 25 > 20 THEN 'temperature_range' WHEN doc_id % 4 = 3 THEN 'provider_enum'
      WHEN doc_id % 4 = 1 THEN 'provider_not_configured' END AS reason
  FROM fx_feedback) WHERE reason IS NOT NULL""")
def workflow_rejects(spark, sf):
    """V1, V4 and M9 over notes with their own settings: every rejected request with its reason."""
    f = FX.fx_feedback(spark, sf)
    names = F.array(*[F.lit(p) for p in ("openai", "anthropic", "google", "other")])
    f = f.withColumns({"provider": F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")),
                       "temperature": (F.col("doc_id") % 25).cast("double") / 10})
    r = I.check_requests(I.fill_defaults(f), configured=["openai", "google"])
    return r.filter("reject_reason is not null").select("request_id", "reject_reason")


@query("pii_model_spans", """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, 'name' AS pii_type, 'Ada Lovelace' AS value, CAST(0.7 AS DOUBLE) AS confidence, 8 AS span_start, 20 AS span_end FROM t
UNION ALL SELECT doc_id, 'address', '12 Elm Street', 0.7, 36 + n, 49 + n FROM t
UNION ALL SELECT doc_id, 'other', 'K7 blue', 0.5, 63 + n, 70 + n FROM t WHERE doc_id % 3 = 0""")
def pii_model_spans(spark, sf):
    """A name, an address and a code that the model has removed from notes of whole documents."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark, coded = F.lit(M.MARK), F.col("doc_id") % 3 == 0

    def note(name, address, code):
        return F.concat(F.lit("Contact "), name, F.lit(" said: "), "text", F.lit("\nShip to "), address,
                        F.lit(" under number "), F.when(coded, code).otherwise(F.lit("zero")), F.lit(" today."))
    notes = d.select("doc_id", note(F.lit("Ada Lovelace"), F.lit("12 Elm Street"), F.lit("K7 blue")).alias("content"),
                     note(mark, mark, mark).alias("redacted_text"))
    return M.model_pii_table(notes, "doc_id")
