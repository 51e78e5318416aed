"""Response quality: success rates, validation statistics, the funnel and its verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions import text as tx
from gradeloom.functions.numbers import percent, ratio

GROUP = ["provider", "strategy"]


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def success_rates(responses: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Total, succeeded, failed and success percentage per group.

    Rows without a question (the empty groups of a results document) count as nothing.
    """
    return (
        responses.groupBy(*keys)
        .agg(F.count("question_id").alias("total"), _n(F.col("success")).alias("succeeded"))
        .withColumn("failed", F.col("total") - F.col("succeeded"))
        .withColumn("success_rate_pct", percent(F.col("succeeded"), F.col("total")))
    )


def template_distribution(responses: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Count and share of every template inside each group."""
    named = responses.withColumn("template", F.coalesce("template", F.lit("unknown")))
    counted = named.groupBy(*keys, "template").agg(F.count(F.lit(1)).alias("n"))
    share = percent(F.col("n"), F.sum("n").over(Window.partitionBy(*keys)))
    return counted.withColumn("percentage", share)


def reported_tokens() -> Column:
    """Output tokens of a row, missing counted as 0."""
    return F.coalesce(F.col("output_tokens"), F.lit(0))


def low_token_responses(responses: DataFrame, limit: int = fv.LOW_TOKEN_LIMIT) -> DataFrame:
    """Successful rows with suspiciously few output tokens."""
    return responses.where(F.col("success") & (reported_tokens() < limit))


def validation_stats(responses: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Failures, low-token count, token spread, upper median and token classes per group.

    Works on the histogram of token counts, so a group's rows are combined where they
    are read and the median needs only one row per distinct token count.
    """
    succeeded = F.coalesce(F.col("success"), F.lit(False))
    histogram = responses.groupBy(
        *keys, F.when(succeeded, reported_tokens()).alias("tokens")
    ).agg(F.count("question_id").alias("n"))
    group = Window.partitionBy(*keys)
    seen = F.sum(F.when(F.col("tokens").isNotNull(), F.col("n"))).over(
        group.orderBy(F.col("tokens").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = F.sum(F.when(F.col("tokens").isNotNull(), F.col("n"))).over(group)
    has = F.col("tokens").isNotNull()
    n = F.col("n")

    def within(low: int | None, high: int | None) -> Column:
        keep = has
        if low is not None:
            keep = keep & (F.col("tokens") >= low)
        if high is not None:
            keep = keep & (F.col("tokens") < high)
        return F.coalesce(F.sum(F.when(keep, n)), F.lit(0))

    return (
        histogram.withColumn("seen", seen)
        .withColumn("counted", counted)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("total_responses"),
            F.coalesce(F.sum(F.when(~has, n)), F.lit(0)).alias("failed_responses"),
            within(None, fv.LOW_TOKEN_LIMIT).alias("low_token_responses"),
            F.min("tokens").alias("min_tokens"),
            F.max("tokens").alias("max_tokens"),
            F.round(F.try_divide(F.sum(F.col("tokens") * n), F.sum(F.when(has, n))), 1).alias("avg_tokens"),
            F.min(F.when(F.col("seen") > F.floor(F.col("counted") / 2), F.col("tokens"))).alias("median_tokens"),
            within(None, 20).alias("tokens_lt_20"),
            within(20, 100).alias("tokens_20_100"),
            within(100, 300).alias("tokens_100_300"),
            within(300, None).alias("tokens_ge_300"),
        )
    )


def suspicious_responses(responses: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """One row per low-token response with previews and the likely-error flag."""
    return low_token_responses(responses).withColumn("_low", F.lower("response")).select(
        *keys,
        F.col("question_id").alias("question_idx"),
        F.substring(F.coalesce("question", F.lit("")), 1, 100).alias("question"),
        reported_tokens().alias("output_tokens"),
        F.substring(F.coalesce("response", F.lit("")), 1, 200).alias("response_preview"),
        F.col("response").alias("full_response"),
        tx.likely_error(F.col("_low")).alias("likely_error"),
        F.coalesce("template", F.lit("unknown")).alias("template_used"),
    )


def likely_error_counts(responses: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Per group: low-token rows and how many of them look like errors."""
    return (
        low_token_responses(responses)
        .withColumn("_low", F.lower("response"))
        .select(*keys, tx.likely_error(F.col("_low")).alias("likely_error"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("low_token_responses"), _n(F.col("likely_error")).alias("likely_errors"))
    )


def groups_with_issues(stats: DataFrame) -> DataFrame:
    """Groups a report has to mention: any failed or low-token response."""
    return stats.where((F.col("failed_responses") > 0) | (F.col("low_token_responses") > 0))


def first_rows(rows: DataFrame, keys: list[str], order: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows of each group; every task passes on at most ``n`` per group."""
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("sample_no", numbered).where(F.col("sample_no") <= n)


def run_header(responses: DataFrame) -> DataFrame:
    """Questions, providers, strategies and their product.

    Providers and strategies are counted over the group rows, so the log is not multiplied.
    """
    groups = responses.select("provider", "strategy").distinct()
    return (
        groups.agg(F.count_distinct("provider").alias("providers"), F.count_distinct("strategy").alias("strategies"))
        .withColumn("questions", responses.agg(F.count_distinct("question_id")).scalar())
        .select("questions", "providers", "strategies", (F.col("questions") * F.col("providers") * F.col("strategies")).alias("total_calls"))
    )


_FUNNEL = ["total", "empty", "errors", "valid", "extractable", "non_extractable", "correct", "incorrect"]


def funnel(graded: DataFrame, keys: list[str] = GROUP, *more: Column) -> DataFrame:
    """total -> empty / errors / valid -> extractable -> correct / incorrect per group, and ``more`` aggregates."""
    valid = F.col("stage") == "valid"
    found = valid & F.col("answer").isNotNull()
    return graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        _n(F.col("stage") == "empty").alias("empty"),
        _n(F.col("stage") == "error").alias("errors"),
        _n(valid).alias("valid"),
        _n(found).alias("extractable"),
        _n(valid & F.col("answer").isNull()).alias("non_extractable"),
        _n(found & F.col("correct")).alias("correct"),
        _n(found & ~F.col("correct")).alias("incorrect"),
        *more,
    )


def funnel_rates(counts: DataFrame) -> DataFrame:
    """Funnel percentages: of all rows, and correct / incorrect of the extractable ones."""
    of_total = [percent(F.col(name), F.col("total")).alias(f"{name}_pct") for name in _FUNNEL[1:6]]
    of_found = [percent(F.col(name), F.col("extractable")).alias(f"{name}_pct") for name in _FUNNEL[6:]]
    return counts.select("*", *of_total, *of_found)


def funnel_with_overall(graded: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """The funnel per group plus one overall row (keys ``ALL``).

    The grouping sets run over the few group rows, not over the responses.
    """
    per_group = funnel(graded, keys)
    sums = [F.sum(name).alias(name) for name in _FUNNEL]
    both = per_group.groupingSets([keys, []], *keys).agg(F.grouping_id().alias("level"), *sums)
    named = [F.when(F.col("level") > 0, "ALL").otherwise(F.col(key)).alias(key) for key in keys]
    return both.select(*named, *_FUNNEL)


def dataset_verdict(funnel_rows: DataFrame) -> DataFrame:
    """EXCELLENT / GOOD / ISSUES out of the overall valid and extraction rates."""
    totals = funnel_rows.agg(*[F.sum(c).alias(c) for c in ("total", "valid", "extractable")])
    valid = percent(F.col("valid"), F.col("total"), None)
    extraction = percent(F.col("extractable"), F.col("total"), None)
    return totals.select(
        F.round(valid, 2).alias("valid_rate_pct"),
        F.round(extraction, 2).alias("extraction_rate_pct"),
        F.when((valid >= 99) & (extraction >= 95), "EXCELLENT")
        .when((valid >= 95) & (extraction >= 85), "GOOD")
        .otherwise("ISSUES")
        .alias("verdict"),
    )


def raw_extraction(graded: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Extraction rate and accuracy of every row, errors not filtered out."""
    found = F.col("answer").isNotNull()
    counts = graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        _n(found).alias("extractable"),
        _n(found & F.col("correct")).alias("correct"),
    )
    return counts.withColumn("extraction_pct", percent(F.col("extractable"), F.col("total"), 1)).withColumn(
        "accuracy_pct", percent(F.col("correct"), F.col("extractable"), 1)
    )


def run_verdict(extraction_rows: DataFrame) -> DataFrame:
    """SUCCESS / PARTIAL / FAIL by extraction rate, and whether accuracy reaches 70 %."""
    totals = extraction_rows.agg(*[F.sum(c).alias(c) for c in ("total", "extractable", "correct")])
    extraction = percent(F.col("extractable"), F.col("total"), None)
    accuracy = percent(F.col("correct"), F.col("extractable"), None)
    return totals.select(
        "total",
        "extractable",
        "correct",
        F.round(extraction, 1).alias("extraction_pct"),
        F.round(accuracy, 1).alias("accuracy_pct"),
        F.when(extraction >= 85, "SUCCESS").when(extraction >= 50, "PARTIAL").otherwise("FAIL").alias("verdict"),
        (accuracy >= 70).alias("accuracy_ok"),
    )


def issue_samples(classified: DataFrame, keys: list[str] = GROUP, n: int = 3) -> DataFrame:
    """First samples per group of error rows and of valid rows without an answer."""
    kind = F.when(F.col("stage") != "valid", "error").when(F.col("answer").isNull(), "non_extractable")
    length = F.when(F.col("stage") == "empty", 100).when(F.col("stage") == "error", 200).otherwise(300)
    empty = F.coalesce(F.col("response"), F.lit("")) == ""
    flagged = classified.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        *keys,
        "kind",
        F.col("question_id").alias("question_idx"),
        F.coalesce("issue", F.lit("NO_ANSWER")).alias("issue"),
        F.when(empty, "NULL").otherwise(F.substring(F.col("response"), F.lit(1), length)).alias("response"),
    )
    return first_rows(flagged, [*keys, "kind"], "question_idx", n)


def sample_report(classified: DataFrame, answer_key: DataFrame, provider: str, strategy: str, n: int = 2) -> DataFrame:
    """First responses of one group with the extracted letter and its verdict."""
    picked = (
        classified.where((F.col("provider") == provider) & (F.col("strategy") == strategy))
        .select("question_id", "question", "response", "answer")
        .orderBy("question_id")
        .limit(n)
    )
    key = answer_key.select("question_id", tx.answer_letter(F.col("answer")).alias("ground_truth"))
    hits = key.join(F.broadcast(picked.select("question_id")), "question_id")  # n rows decide what is looked up
    hits = hits.groupBy("question_id").agg(F.min("ground_truth").alias("ground_truth"))
    return picked.join(F.broadcast(hits), "question_id", "left").select(
        "question_id",
        F.substring("question", 1, 100).alias("question"),
        tx.preview(F.col("response"), 200).alias("response"),
        F.coalesce("answer", F.lit("None")).alias("extracted"),
        "ground_truth",
        F.when(F.col("answer").isNotNull(), F.when(F.col("answer").eqNullSafe(F.col("ground_truth")), "CORRECT").otherwise("WRONG")).alias("result"),
    )


def accuracy_by_template(graded: DataFrame) -> DataFrame:
    """Answer accuracy of the extractable valid rows by provider and template."""
    counts = funnel(graded, ["provider", "template"])
    return counts.select(
        "provider", "template", "extractable", "correct",
        F.round(ratio(F.col("correct"), F.col("extractable")) * 100, 1).alias("accuracy_pct"),
    )
