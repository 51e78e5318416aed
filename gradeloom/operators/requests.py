"""Planning calls: work plan, prompts, caps, and request rows in the batch-file format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.messages import custom_id, lettered_question, user_prompt
from gradeloom.functions.numbers import percent
from gradeloom.operators.prepare import dimension, lookup_table


def work_plan(questions: DataFrame, strategies: list[str] = fv.STRATEGIES, providers: list[str] = fv.PROVIDERS) -> DataFrame:
    """Every question with every strategy and provider.

    The two short lists are exploded in place, so no join and no shuffle is needed;
    pass narrow rows, texts can be attached afterwards.
    """
    pairs = F.array(
        *[F.struct(F.lit(p).alias("provider"), F.lit(s).alias("strategy")) for p in providers for s in strategies]
    )
    return questions.select("*", F.explode(pairs).alias("_w")).select(
        *questions.columns, F.col("_w.provider").alias("provider"), F.col("_w.strategy").alias("strategy")
    )


def chosen_template(baseline: str = fv.BASELINE_TEMPLATE, fallback: str = fv.FALLBACK_PROMPT_TEMPLATE) -> Column:
    """Template of the row's strategy: constant for the baseline, predicted for routers."""
    return (
        F.when(F.col("strategy") == "baseline", F.lit(baseline))
        .when(F.col("strategy") == "simple_neural", F.coalesce("simple_neural", F.lit(fallback)))
        .when(F.col("strategy") == "roberta", F.coalesce("roberta", F.lit(fallback)))
        .otherwise(F.lit(fallback))
    )


def prompt_table(spark: SparkSession, prompts: dict[str, dict[str, str]] = fv.PROMPTS) -> DataFrame:
    rows = [(family, template, text) for family, texts in prompts.items() for template, text in texts.items()]
    return lookup_table(
        spark,
        prompt_family=[r[0] for r in rows],
        template=[r[1] for r in rows],
        system_prompt=[r[2] for r in rows],
    )


def cap_table(spark: SparkSession, caps: dict[str, int] = fv.LIVE_MAX_TOKENS) -> DataFrame:
    return dimension(spark, caps, "template", "max_tokens").withColumn("max_tokens", F.col("max_tokens").cast("int"))


def with_prompts(planned: DataFrame, prompts: DataFrame, fallback: str = fv.FALLBACK_PROMPT_TEMPLATE) -> DataFrame:
    """Attach ``system_prompt``: the provider's prompt family, unknown templates get the fallback's."""
    families = prompts.select("prompt_family").distinct().select(
        F.col("prompt_family").alias("own_family"), F.lit(True).alias("has_family")
    )
    defaults = prompts.where(F.col("template") == fallback).select("prompt_family", F.col("system_prompt").alias("_fallback"))
    return (
        planned.join(families, F.col("provider") == F.col("own_family"), "left")
        .withColumn("prompt_family", F.when(F.col("has_family"), F.col("provider")).otherwise("default"))
        .drop("own_family", "has_family")
        .join(prompts, ["prompt_family", "template"], "left")
        .join(defaults, "prompt_family", "left")
        .withColumn("system_prompt", F.coalesce("system_prompt", "_fallback"))
        .drop("_fallback")
    )


def with_caps(planned: DataFrame, caps: DataFrame, default: int = fv.DEFAULT_MAX_TOKENS) -> DataFrame:
    """Attach ``max_tokens`` of the template, or the default cap."""
    return planned.join(caps, "template", "left").withColumn("max_tokens", F.coalesce("max_tokens", F.lit(default)))


def planned_calls(
    questions: DataFrame,
    predictions: DataFrame,
    strategies: list[str] = fv.STRATEGIES,
    providers: list[str] = fv.PROVIDERS,
    caps: dict[str, int] = fv.LIVE_MAX_TOKENS,
) -> DataFrame:
    """Plan rows with template, prompt and cap.

    Predictions are joined once per question; after the explode only short lookup tables
    are joined, so the multiplied rows are never shuffled.
    """
    spark = questions.sparkSession
    routed = questions.join(predictions.select("question_id", "simple_neural", "roberta"), "question_id", "left")
    plan = work_plan(routed, strategies, providers).withColumn("template", chosen_template())
    return with_caps(with_prompts(plan.drop("simple_neural", "roberta"), prompt_table(spark)), cap_table(spark, caps))


def request_lines(calls: DataFrame, mode: str = "batch", model: str = "gpt-4o-mini") -> DataFrame:
    """(custom_id, value): one JSON request per call.

    ``batch`` sends a system and a user message, ``live`` one combined user message.
    """
    question = lettered_question(F.col("question"), F.col("choices"))
    if mode == "batch":
        messages = F.array(
            F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content")),
            F.struct(F.lit("user").alias("role"), question.alias("content")),
        )
    else:
        messages = F.array(
            F.struct(F.lit("user").alias("role"), user_prompt(F.col("system_prompt"), question).alias("content"))
        )
    identifier = custom_id(F.col("question_id"), F.col("strategy"))
    body = F.struct(
        F.lit(model).alias("model"),
        messages.alias("messages"),
        F.col("max_tokens"),
        F.lit(0.0).alias("temperature"),
    )
    line = F.struct(
        identifier.alias("custom_id"), F.lit(fv.REQUEST_METHOD).alias("method"), F.lit(fv.REQUEST_PATH).alias("url"), body.alias("body")
    )
    return calls.select("provider", "strategy", identifier.alias("custom_id"), F.to_json(line).alias("value"))


def batch_progress(jobs: DataFrame) -> DataFrame:
    """Percent done and state class of batch jobs (status, completed, total)."""
    state = (
        F.when(F.col("status") == "completed", "done")
        .when(F.col("status").isin(fv.STOPPED_STATES), "stopped")
        .when(F.col("status").isin(fv.PENDING_STATES), "pending")
        .otherwise("unknown")
    )
    return jobs.withColumn("percent_done", percent(F.col("completed"), F.col("total"), 1)).withColumn("state", state)


def all_complete(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """True where every job of the group is completed."""
    return jobs.groupBy(*(keys or [])).agg(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("all_complete"))


def routed_templates(predictions: DataFrame, routers: list[str], fallback: str, baseline: str = fv.BASELINE_TEMPLATE) -> DataFrame:
    """Per question the template of each strategy, missing predictions replaced."""
    return predictions.select(
        "question_id",
        F.lit(baseline).alias("baseline"),
        *[F.coalesce(F.col(r), F.lit(fallback)).alias(r) for r in routers],
    )
