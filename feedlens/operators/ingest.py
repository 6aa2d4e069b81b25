"""Ingest step as table jobs: A1/A2 defaults, V1 validation, N1–N6 normalisation, P1–P5 PII."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.jsonsalvage import salvage
from . import repair as RP


def fill_defaults(df: DataFrame) -> DataFrame:
    """A2: service defaults for optional request fields (columns are added when absent)."""
    defaults = {
        "source": F.lit(S.DEFAULT_SOURCE),
        "customer_id": F.lit(None).cast("string"),
        "metadata": F.create_map().cast("map<string,string>"),
        "provider": F.lit(S.DEFAULT_PROVIDER),
        "model": F.lit(S.DEFAULT_MODEL),
        "temperature": F.lit(S.DEFAULT_TEMPERATURE),
        "max_tokens": F.lit(S.DEFAULT_MAX_TOKENS),
        "timeout_seconds": F.lit(S.DEFAULT_TIMEOUT_SECONDS),
        "persona": F.lit(S.DEFAULT_PERSONA),
    }
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def read_feedback(spark, path: str, fmt: str = "json") -> DataFrame:
    """A1: read notes with a fixed schema (no inference); parquet or JSON lines."""
    reader = spark.read.schema(S.FEEDBACK)
    return fill_defaults(reader.format(fmt).load(path))


def validate(df: DataFrame, content: str = "content") -> DataFrame:
    """V1: adds `reject_reason` (null when accepted). Length is checked before the strip."""
    c = F.col(content)
    reason = (F.when(c.isNull(), F.lit("missing_content"))
              .when(F.length(c) < S.MIN_CONTENT_CHARS, F.lit("too_short"))
              .when(X.is_blank(c), F.lit("blank")))
    return df.withColumn("reject_reason", reason)


def check_requests(df: DataFrame, configured: list[str] | None = None) -> DataFrame:
    """V1, V4 and M9 in one: adds the first `reject_reason` of a request with its model settings."""
    checked = RP.conform_config(validate(df))
    reason = F.coalesce("reject_reason", F.when(~F.col("valid"), F.array_join("violations", ",")))
    if configured is not None:
        reason = F.coalesce(reason, F.when(~F.col("provider").isin(*configured), F.lit("provider_not_configured")))
    return checked.withColumn("reject_reason", reason).drop("violations", "valid")


def accepted(df: DataFrame) -> DataFrame:
    return validate(df).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(df: DataFrame) -> DataFrame:
    return validate(df).filter(F.col("reject_reason").isNotNull())


def normalize(df: DataFrame, content: str = "content") -> DataFrame:
    """N1–N3 and P1–P4 without a model: stripped text, words, language, PII, redaction."""
    stripped = X.strip_ws(F.col(content))
    out = df.withColumn(content, stripped)
    out = out.withColumn("detected_pii", X.detect_pii(F.col(content)))
    out = out.withColumn("has_pii", F.size("detected_pii") > 0)
    out = out.withColumn("cleaned_content", X.redact(F.col(content)))
    out = out.withColumn("word_count", X.word_count(F.col(content)))
    if "lang" in df.columns:
        out = out.withColumn("language", X.language(F.col("lang")))
    return out


def pii_table(df: DataFrame, key: str = "request_id", content: str = "content") -> DataFrame:
    """P1 exploded: one row per detection with its 0-based span."""
    return (df.select(key, F.explode(X.detect_pii(F.col(content))).alias("p"))
            .select(key, F.col("p.pii_type").alias("pii_type"), F.col("p.value").alias("value"),
                    F.col("p.confidence").alias("confidence"),
                    F.col("p.location.start").alias("span_start"),
                    F.col("p.location.end").alias("span_end")))


def pii_by_type(df: DataFrame, key: str = "request_id", content: str = "content") -> DataFrame:
    """P5: detections per type (partial aggregation before the shuffle)."""
    return pii_table(df, key, content).groupBy("pii_type").agg(F.count(F.lit(1)).alias("n"))


def language_mix(df: DataFrame) -> DataFrame:
    """N4."""
    return df.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def merge_ingest(notes: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Typed ingest answer with a safe fallback.

    `responses(key, content)` holds the model's raw answer text. Parsing failures, missing
    answers and unknown languages fall back to English, our regex PII result and our redacted
    text – never the unredacted original (K1). The model's own redacted text is redacted once more.
    """
    parsed = salvage(responses.select(key, F.col("content").alias("answer")), "answer")
    parsed = parsed.select(key, F.from_json("json_text", S.INGEST_RESPONSE).alias("r"),
                           F.col("strategy"))
    base = normalize(notes)
    j = base.join(parsed, key, "left")
    use_model = F.col("r").isNotNull()
    lang_raw = F.lower(X.strip_ws(F.col("r.language")))
    # K2: a language outside the enum becomes 'other' instead of discarding the answer
    lang = F.when(lang_raw.isNull(), F.lit("en")).when(lang_raw.isin(*S.LANGUAGES), lang_raw) \
        .otherwise(F.lit("other"))
    return j.select(
        key,
        "content",
        F.when(use_model, lang).otherwise(F.lit("en")).alias("language"),
        "detected_pii",
        (F.col("has_pii") | F.coalesce(F.when(use_model, F.col("r.pii_detected")), F.lit(False)))
        .alias("has_pii"),
        F.when(use_model, F.coalesce(X.redact(F.col("r.redacted_text")), F.col("cleaned_content")))
        .otherwise(F.col("cleaned_content")).alias("cleaned_content"),
        F.when(use_model, F.coalesce(F.col("r.word_count").cast("int"), F.col("word_count")))
        .otherwise(F.col("word_count")).alias("word_count"),
        F.when(use_model, F.col("r.input_quality")).alias("input_quality"),
        F.when(use_model, F.lit("model")).when(F.col("r").isNull() & F.col("strategy").isNull(),
                                               F.lit("no_answer")).otherwise(F.lit("fallback"))
        .alias("ingest_source"),
    )
