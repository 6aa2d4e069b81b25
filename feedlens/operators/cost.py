"""C1 step cost and the price dimension (A3, M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


def prices(spark: SparkSession) -> DataFrame:
    """A3 + M8: listed models with capability flags (6 rows; fixed size, safe to broadcast)."""
    p = spark.createDataFrame(S.PRICE_ROWS, "provider string, model string, price_in double, price_out double")
    json_mode, fn_calling = capability_flags()
    return p.withColumn("supports_json_mode", json_mode).withColumn("supports_function_calling", fn_calling)


def default_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.DEFAULT_PRICE_ROWS, "provider string, default_in double, default_out double")


def capability_flags(model: str = "model", provider: str = "provider"):
    """M8: json-mode and function-calling support, by the service's model-name rules."""
    m, p = F.col(model), F.col(provider)
    json_mode = F.when(p == "openai", m.contains("gpt-4") | m.contains("gpt-3.5")).otherwise(F.lit(False))
    fn_calling = F.when(p == "anthropic", m.contains("claude-3")).otherwise(F.lit(True))
    return json_mode, fn_calling


def model_catalog(models: DataFrame) -> DataFrame:
    """Prices (listed or provider default) and capability flags for observed (provider, model)."""
    spark = models.sparkSession
    p = F.broadcast(prices(spark).select("provider", "model", "price_in", "price_out"))
    d = F.broadcast(default_prices(spark))
    j = models.join(p, ["provider", "model"], "left").join(d, ["provider"], "left")
    json_mode, fn_calling = capability_flags()
    return j.select("provider", "model",
                    F.coalesce("price_in", "default_in").alias("price_in"),
                    F.coalesce("price_out", "default_out").alias("price_out"),
                    F.col("price_in").isNotNull().alias("listed"),
                    json_mode.alias("supports_json_mode"), fn_calling.alias("supports_function_calling"),
                    *[c for c in models.columns if c not in ("provider", "model")])


def with_cost(df: DataFrame, tokens_in: str = "tokens_input", tokens_out: str = "tokens_output",
              out: str = "cost_usd") -> DataFrame:
    """round(in/1e6·p_in + out/1e6·p_out, 6) with the provider default for unlisted models.

    Computed exactly as integer micro-dollars in decimal (HALF_UP, K12), published as double.
    Both dimensions have a fixed handful of rows, so they are broadcast.
    """
    spark = df.sparkSession
    p = F.broadcast(prices(spark).select("provider", "model", "price_in", "price_out"))
    d = F.broadcast(default_prices(spark))
    j = df.join(p, ["provider", "model"], "left").join(d, ["provider"], "left")
    pin = F.coalesce(F.col("price_in"), F.col("default_in")).cast("decimal(12,6)")
    pout = F.coalesce(F.col("price_out"), F.col("default_out")).cast("decimal(12,6)")
    micro = F.round(F.col(tokens_in).cast("decimal(18,0)") * pin
                    + F.col(tokens_out).cast("decimal(18,0)") * pout, 0)
    return (j.withColumn(out, micro.cast("double") / 1e6)
            .drop("price_in", "price_out", "default_in", "default_out"))
