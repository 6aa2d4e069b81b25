"""Model answers → content, tokens, finish reason (M2–M5) and parsed objects (J-1 … J-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.jsonsalvage import salvage


def envelope_content(env: str = "envelope"):
    """M2: OpenAI answers take function_call.arguments ('{}' without any), else the first tool call's
    args as JSON; the other providers, and OpenAI without either, take content, else ''."""
    e = F.col(env)
    call = F.get_json_object(e, "$.additional_kwargs.function_call")
    called = F.when(call.isNotNull(), F.coalesce(F.get_json_object(call, "$.arguments"), F.lit("{}")))
    return F.coalesce(
        F.when(F.col("provider") == "openai", F.coalesce(called, F.get_json_object(e, "$.tool_calls[0].args"))),
        F.get_json_object(e, "$.content"),
        F.lit(""))


def _tok(e, path):
    """A token count, null if it is missing or no number (12.0 counts as 12)."""
    return F.get_json_object(e, path).try_cast("double").try_cast("long")


def unpack_envelope(df: DataFrame, env: str = "envelope", prompt: str = "prompt") -> DataFrame:
    """M2–M5 on a table (provider, envelope JSON text, prompt); unreadable counts are 0 and flagged."""
    e = F.col(env)
    p = F.col("provider")
    tin = (F.when(p == "openai", _tok(e, "$.response_metadata.token_usage.prompt_tokens"))
           .when(p == "anthropic", _tok(e, "$.response_metadata.usage.input_tokens"))
           .otherwise(_tok(e, "$.response_metadata.usage_metadata.prompt_token_count")))
    tout = (F.when(p == "openai", _tok(e, "$.response_metadata.token_usage.completion_tokens"))
            .when(p == "anthropic", _tok(e, "$.response_metadata.usage.output_tokens"))
            .otherwise(_tok(e, "$.response_metadata.usage_metadata.candidates_token_count")))
    finish = (F.when(p == "anthropic", F.coalesce(F.get_json_object(e, "$.response_metadata.stop_reason"),
                                                   F.lit("end_turn")))
              .otherwise(F.coalesce(F.get_json_object(e, "$.response_metadata.finish_reason"), F.lit("stop"))))
    out = df.withColumn("content", envelope_content(env))
    zero = F.lit(0).cast("long")
    out = out.withColumns({"tokens_unreadable": tin.isNull() | tout.isNull(),
                           "tokens_input_raw": F.coalesce(tin, zero), "tokens_output_raw": F.coalesce(tout, zero)})
    return estimate_tokens(out, prompt).withColumn("finish_reason", finish)


def estimate_tokens(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """M4: Google answers without counts get int(words × 1.3); `tokens_estimated` flags them."""
    google = F.col("provider") == "google"
    est_in = F.floor(X.word_count(F.col(prompt)).cast("double") * F.lit(S.TOKEN_ESTIMATE_FACTOR)).cast("long")
    est_out = F.floor(X.word_count(F.col("content")).cast("double") * F.lit(S.TOKEN_ESTIMATE_FACTOR)).cast("long")
    need_in = google & (F.col("tokens_input_raw") == 0)
    need_out = google & (F.col("tokens_output_raw") == 0)
    return (df.withColumn("tokens_input", F.when(need_in, est_in).otherwise(F.col("tokens_input_raw")))
            .withColumn("tokens_output", F.when(need_out, est_out).otherwise(F.col("tokens_output_raw")))
            .withColumn("tokens_estimated", need_in | need_out)
            .drop("tokens_input_raw", "tokens_output_raw"))


def parse(df: DataFrame, step: str, content: str = "content") -> DataFrame:
    """J-1 … J-9 then typed: adds `json_text`, `strategy`, `n_keys`, `parsed` (struct of the step)
    and `type_errors`.

    `from_json` turns a field of the wrong JSON type into null; read alone, that null would be
    "repaired" like a missing field. A second, schema-free parse (`map<string,string>`) shows which
    keys were present with a value, so such fields are reported as `type:<field>` (a V2 violation).
    An answer that no strategy could read has the single error `unparseable_json`, so no repair can
    make it valid.
    """
    schema = S.STEP_SCHEMAS[step]
    out = salvage(df, content)
    out = out.withColumns({"n_keys": F.size(F.json_object_keys("json_text")),
                           "parsed": F.from_json("json_text", schema),
                           "_raw": F.from_json("json_text", "map<string,string>")})
    errs = F.array_compact(F.array(*[
        F.when(F.col("_raw")[f.name].isNotNull() & F.col("parsed")[f.name].isNull(), F.lit(f"type:{f.name}"))
        for f in schema.fields]))
    unread = F.array(F.lit("unparseable_json"))
    return out.withColumn("type_errors", F.when(F.col("json_text").isNotNull(), errs).otherwise(unread)).drop("_raw")


def parse_rejects(parsed: DataFrame, content: str = "content") -> DataFrame:
    """J-9: answers no strategy could read, with the first 500 characters."""
    return (parsed.filter(F.col("strategy") == "rejected")
            .withColumn("reason", F.lit("unparseable_json"))
            .withColumn("preview", F.substring(F.col(content), 1, 500)))


def parse_report(parsed: DataFrame) -> DataFrame:
    """J-10: rows and share per strategy (one shuffle of at most eight groups)."""
    from pyspark.sql import Window
    agg = parsed.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
