"""Token usage, savings against the baseline strategy, and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.numbers import percent, ratio, whole_average
from gradeloom.functions.text import token_estimate
from gradeloom.operators.prepare import dimension, lookup_table


def answered(responses: DataFrame) -> DataFrame:
    """Successful rows with a non-empty response."""
    return responses.where(F.col("success") & (F.coalesce("response", F.lit("")) != ""))


def estimated_tokens() -> Column:
    """Estimated tokens of a successful row with a non-empty response, else NULL."""
    counts = F.col("success") & (F.coalesce("response", F.lit("")) != "")
    return F.when(counts, token_estimate(F.col("response")))


def token_totals(responses: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Total, average and number of counted responses per provider and strategy.

    ``tokens`` is the token expression: by default estimated from the text, or pass
    the reported ``output_tokens``. Groups without a counted response show zeros.
    """
    counts = F.col("success") & (F.coalesce("response", F.lit("")) != "")
    value = estimated_tokens() if tokens is None else F.when(counts, F.coalesce(tokens, F.lit(0)))
    slim = responses.select("provider", "strategy", value.alias("tokens"))
    return (
        slim.groupBy("provider", "strategy")
        .agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.count("tokens").alias("counted"))
        .withColumn("avg_tokens", whole_average(F.col("total_tokens"), F.col("counted")))
    )


def with_savings(totals: DataFrame, value: str = "total_tokens", baseline: str = "baseline") -> DataFrame:
    """Savings of every strategy against the provider's baseline row (few rows)."""
    provider = Window.partitionBy("provider")
    base = F.max(F.when(F.col("strategy") == baseline, F.col(value))).over(provider)
    return totals.withColumn("savings", base - F.col(value)).withColumn(
        "savings_pct", F.when(base.isNotNull(), percent(F.col("savings"), base))
    )


def token_savings(responses: DataFrame, tokens: Column | None = None) -> DataFrame:
    return with_savings(token_totals(responses, tokens))


def capped_tokens(predictions_long: DataFrame, caps: DataFrame) -> DataFrame:
    """Tokens if every response used its template's cap, and savings against the baseline."""
    totals = (
        predictions_long.groupBy("strategy", "template")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(caps, "template", "left")
        .groupBy("strategy")
        .agg(F.sum(F.col("n") * F.coalesce("max_tokens", F.lit(fv.DEFAULT_MAX_TOKENS))).alias("total_tokens"))
    )
    base = F.max(F.when(F.col("strategy") == "baseline", F.col("total_tokens"))).over(Window.partitionBy(F.lit(1)))
    return totals.withColumn("savings", base - F.col("total_tokens")).withColumn(
        "savings_pct", percent(F.col("savings"), base)
    )


def reported_usage(responses: DataFrame) -> DataFrame:
    """Input and output tokens of the successful calls per provider and strategy."""
    return (
        responses.where(F.col("success"))
        .groupBy("provider", "strategy")
        .agg(
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
            F.count(F.lit(1)).alias("calls"),
        )
        .withColumn("avg_input", whole_average(F.col("input_tokens"), F.col("calls")))
        .withColumn("avg_output", whole_average(F.col("output_tokens"), F.col("calls")))
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    )


def output_prices(spark: SparkSession, prices: dict[str, float] = fv.FIGURE_OUTPUT_PRICE) -> DataFrame:
    return dimension(spark, prices, "provider", "output_price")


def output_cost(totals: DataFrame, prices: DataFrame) -> DataFrame:
    """Output cost of token totals and its saving against the baseline."""
    cost = F.col("total_tokens") / F.lit(1e6) * F.col("output_price")
    priced = totals.join(prices, "provider").withColumn("cost", F.round(cost, 6))
    base = F.max(F.when(F.col("strategy") == "baseline", F.col("total_tokens"))).over(Window.partitionBy("provider"))
    saved = F.round(ratio(base - F.col("total_tokens"), base) * 100, 1)
    return priced.withColumn("cost_savings_pct", saved)


def call_cost(usage: DataFrame, prices: dict[str, tuple[float, float]] = fv.TESTING_PRICE) -> DataFrame:
    """Input and output cost per provider, and the discounted batch cost."""
    spark = usage.sparkSession
    table = lookup_table(
        spark,
        provider=list(prices),
        input_price=[p[0] for p in prices.values()],
        output_price=[p[1] for p in prices.values()],
    )
    per_provider = usage.groupBy("provider").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    paid_in = F.col("input_tokens") / F.lit(1e6) * F.col("input_price")
    paid_out = F.col("output_tokens") / F.lit(1e6) * F.col("output_price")
    return per_provider.join(table, "provider").select(
        "provider",
        F.round(paid_in, 6).alias("input_cost"),
        F.round(paid_out, 6).alias("output_cost"),
        F.round(paid_in + paid_out, 6).alias("total_cost"),
        F.round((paid_in + paid_out) * fv.BATCH_DISCOUNT, 6).alias("batch_cost"),
    )


def cost_quality(totals: DataFrame, prices: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Cost and answer accuracy per provider and strategy (both sides a few rows)."""
    return (
        totals.join(prices, "provider")
        .join(accuracy.select("provider", "strategy", "accuracy_pct"), ["provider", "strategy"])
        .select(
            "provider",
            "strategy",
            F.round(F.col("total_tokens") / F.lit(1e6) * F.col("output_price"), 6).alias("cost"),
            "accuracy_pct",
        )
    )


def request_statistics(responses: DataFrame) -> DataFrame:
    """Requests (every attempt), failed calls and success rate per provider."""
    stats = responses.groupBy("provider").agg(
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("total_requests"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("failures"),
    )
    return stats.withColumn(
        "success_rate", F.round(ratio(F.col("total_requests") - F.col("failures"), F.col("total_requests")), 6)
    )
