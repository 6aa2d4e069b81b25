"""Prompt tables (B1–B7, A8). Wording is ours; the structure follows the service's four steps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.text import word_count
from .cost import with_cost

SYSTEM_PROMPTS = {
    "ingest": "You normalise customer notes: detect the language, find personal data, return a redacted copy.",
    "extract": "You extract structured sales insights from a customer note. Use only what the note says.",
    "self_check": "You verify each extracted claim against the note and flag anything unsupported.",
    "rewrite": "You write a concise, evidence-based value proposition for the given audience.",
}
SCHEMA_INTRO = "\n\nAnswer with JSON that follows this schema:\n"
PERSONA_LABELS = {"executive": "Executive (return on investment, business impact)",
                  "technical": "Technical (architecture, integration, reliability)",
                  "business_user": "Business user (daily workflow, ease of use)",
                  "procurement": "Procurement (cost, terms, risk)"}


def _json_type(dt: T.DataType) -> dict:
    if isinstance(dt, T.StringType):
        return {"type": "string"}
    if isinstance(dt, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(dt, (T.LongType, T.IntegerType)):
        return {"type": "integer"}
    if isinstance(dt, T.DoubleType):
        return {"type": "number"}
    if isinstance(dt, T.ArrayType):
        return {"type": "array", "items": _json_type(dt.elementType)}
    if isinstance(dt, T.StructType):
        return {"type": "object", "properties": {f.name: _json_type(f.dataType) for f in dt.fields}}
    return {}


def schema_text(step: str) -> str:
    """One literal per step, derived from the step's StructType (driver-side metadata only)."""
    return json.dumps(_json_type(S.STEP_SCHEMAS[step]), separators=(",", ":"))


def ingest_prompt(content: Column, source: Column) -> Column:
    """B1."""
    return F.concat(F.lit("Review this customer note and normalise it.\n\nNote: "), content,
                    F.lit("\nSource: "), source,
                    F.lit("\n\nReport the language, any personal data, a redacted copy and the word count."))


def extract_prompt(cleaned: Column) -> Column:
    """B2."""
    return F.concat(F.lit("Pull structured insights out of this note:\n\n"), cleaned,
                    F.lit("\n\nList the problem, current solution, pain points, value drivers, "
                          "stakeholders, timeline and budget signals."))


def extracted_json(df_cols: list[str] | None = None) -> Column:
    cols = df_cols or [f.name for f in S.EXTRACTED.fields]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def self_check_prompt(cleaned: Column, extracted: Column) -> Column:
    """B3 (compact JSON; the service indents it, which only changes whitespace)."""
    return F.concat(F.lit("Check this extraction against the note.\n\nNOTE:\n"), cleaned,
                    F.lit("\n\nEXTRACTION:\n"), extracted,
                    F.lit("\n\nMark each claim as supported or not and rate the risk of invented facts."))


def rewrite_prompt(extracted: Column, persona: Column) -> Column:
    """B4; persona is a column (K9)."""
    label = F.coalesce(*[F.when(persona == k, F.lit(v)) for k, v in PERSONA_LABELS.items()],
                       F.lit(PERSONA_LABELS[S.DEFAULT_PERSONA]))
    return F.concat(F.lit("Write a value proposition from these checked insights:\n\n"), extracted,
                    F.lit("\n\nAudience: "), label)


def with_system(df: DataFrame, step_col: str = "step") -> DataFrame:
    """Attach system prompt and schema; Google and Anthropic get the schema in the prompt.

    The four step texts are a literal map looked up per row, so no join (and no exchange) is needed.
    """
    systems = F.create_map(*[x for k, v in SYSTEM_PROMPTS.items() for x in (F.lit(k), F.lit(v))])
    schemas = F.create_map(*[x for k in SYSTEM_PROMPTS for x in (F.lit(k), F.lit(schema_text(k)))])
    out = df.withColumns({"system_prompt": systems[F.col(step_col)], "json_schema": schemas[F.col(step_col)]})
    inline = F.col("provider").isin("google", "anthropic")
    return out.withColumn("prompt", F.when(inline, F.concat(F.col("prompt"), F.lit(SCHEMA_INTRO), F.col("json_schema")))
                          .otherwise(F.col("prompt")))


def cost_preview(prompts: DataFrame, max_tokens: str = "max_tokens") -> DataFrame:
    """Estimated input tokens (words × 1.3) and the upper-bound cost with max_tokens out."""
    est = F.floor(word_count(F.col("prompt")).cast("double") * F.lit(S.TOKEN_ESTIMATE_FACTOR)).cast("long")
    p = prompts.withColumn("tokens_input", est).withColumn("tokens_output", F.col(max_tokens).cast("long"))
    return with_cost(p, out="cost_preview_usd")


def write_prompts(prompts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The prompt table leaves Spark as parquet, partitioned by step."""
    (prompts.select("run_id", "step", "provider", "model", "system_prompt", "prompt", "json_schema")
     .write.mode(mode).partitionBy("step").parquet(path))
