"""Routing quality: accuracy, agreement, confusion, weighted scores, template mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.numbers import percent, ratio
from gradeloom.operators.quality import success_rates


def routing_truth(predictions: DataFrame) -> DataFrame:
    """(question_id, truth): ground truth, else the baseline template, else ``standard``."""
    return predictions.select(
        "question_id", F.coalesce("ground_truth", "baseline", F.lit("standard")).alias("truth")
    )


def long_predictions(predictions: DataFrame, strategies: list[str] = fv.STRATEGIES) -> DataFrame:
    """Wide prediction columns to (question_id, strategy, template) rows."""
    return predictions.unpivot("question_id", strategies, "strategy", "template")


def _against_predictions(counted: DataFrame, predictions: DataFrame) -> DataFrame:
    """Attach the number of predictions as ``n_predictions``."""
    return counted.withColumn("n_predictions", predictions.agg(F.count(F.lit(1))).scalar())


def router_accuracy(predictions: DataFrame, responses: DataFrame, routers: list[str] = fv.STRATEGIES[1:]) -> DataFrame:
    """Matches, misses and accuracy per provider and router.

    The denominator is the number of predictions, whether or not a response exists. A
    group none of whose questions has a prediction shows 0 matches.
    """
    used = responses.where(F.col("strategy").isin(routers)).select("question_id", "provider", "strategy", "template")
    matched = (
        used.join(routing_truth(predictions), "question_id", "left")
        .groupBy("provider", "strategy")
        .agg(F.count_if(F.coalesce(F.col("truth") == F.col("template"), F.lit(False))).alias("matches"))
    )
    return _against_predictions(matched, predictions).select(
        "provider",
        "strategy",
        "matches",
        (F.col("n_predictions") - F.col("matches")).alias("misses"),
        percent(F.col("matches"), F.col("n_predictions")).alias("accuracy_pct"),
    )


def _side_by_side(responses: DataFrame, first: str, second: str) -> DataFrame:
    """Per (provider, question): does each router have a row, and which template."""
    ours = F.col("strategy") == first
    theirs = F.col("strategy") == second
    return (
        responses.where(F.col("strategy").isin(first, second))
        .groupBy("provider", "question_id")
        .agg(
            F.count_if(ours).alias("n_first"),
            F.count_if(theirs).alias("n_second"),
            F.max(F.when(ours, F.col("template"))).alias("first_template"),
            F.max(F.when(theirs, F.col("template"))).alias("second_template"),
        )
        .withColumn("both", (F.col("n_first") > 0) & (F.col("n_second") > 0))
    )


def router_agreement(
    predictions: DataFrame, responses: DataFrame, first: str = "simple_neural", second: str = "roberta"
) -> DataFrame:
    """Questions both routers answered, and the share of predictions with the same template.

    A provider with rows of one router only shows 0.
    """
    same = F.col("both") & F.col("first_template").eqNullSafe(F.col("second_template"))
    compared = (
        _side_by_side(responses, first, second)
        .groupBy("provider")
        .agg(F.count_if("both").alias("compared"), F.count_if(same).alias("agreed"))
    )
    return (
        _against_predictions(compared, predictions)
        .withColumn("agreement_pct", percent(F.col("agreed"), F.col("n_predictions")))
        .drop("n_predictions")
    )


STRATEGY_PAIRS = [("baseline", "simple_neural"), ("baseline", "roberta"), ("simple_neural", "roberta")]


def compare_strategies(responses: DataFrame, pairs: list[tuple[str, str]] = STRATEGY_PAIRS) -> DataFrame:
    """Success rates of two strategies on the same provider and their difference.

    Both rates are relative to the size of the first strategy; a pair needs both.
    """
    rates = success_rates(responses)
    sides = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs])
    return (
        rates.withColumn("pair", F.explode(sides))
        .where((F.col("strategy") == F.col("pair.first")) | (F.col("strategy") == F.col("pair.second")))
        .groupBy("provider", "pair")
        .agg(
            F.max(F.when(F.col("strategy") == F.col("pair.first"), F.col("total"))).alias("base"),
            F.max(F.when(F.col("strategy") == F.col("pair.first"), F.col("succeeded"))).alias("first_ok"),
            F.max(F.when(F.col("strategy") == F.col("pair.second"), F.col("succeeded"))).alias("second_ok"),
        )
        .where(F.col("first_ok").isNotNull() & F.col("second_ok").isNotNull())
        .select(
            "provider",
            F.concat_ws("_vs_", "pair.first", "pair.second").alias("comparison"),
            percent(F.col("first_ok"), F.col("base")).alias("first_success_pct"),
            percent(F.col("second_ok"), F.col("base")).alias("second_success_pct"),
            percent(F.col("second_ok") - F.col("first_ok"), F.col("base")).alias("improvement_pct"),
        )
    )


def classifier_accuracy(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Correct, total and accuracy of (ground_truth, predicted) rows, per ``keys``."""
    return (
        scored.groupBy(*(keys or []))
        .agg(
            F.count_if(F.col("ground_truth").eqNullSafe(F.col("predicted"))).alias("correct"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn("accuracy_pct", percent(F.col("correct"), F.col("total")))
    )


def confusion(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sparse confusion matrix as rows (ground_truth, predicted, n)."""
    return scored.groupBy(*(keys or []), "ground_truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_table(cells: DataFrame, labels: list[str] = fv.TEMPLATES) -> DataFrame:
    """Confusion matrix with one column per predicted label, zero-filled."""
    return cells.groupBy("ground_truth").pivot("predicted", labels).agg(F.sum("n")).na.fill(0, labels)


def labels_seen(scored: DataFrame) -> DataFrame:
    """Every label that occurs as truth or prediction."""
    return (
        scored.select(F.col("ground_truth").alias("label"))
        .distinct()
        .union(scored.select(F.col("predicted").alias("label")).distinct())
        .distinct()
    )


def weighted_scores(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from the confusion cells."""
    keys = keys or []
    cells = confusion(scored, keys)
    sides = F.array(
        F.struct(F.col("ground_truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed")),
    )
    hit = F.when(F.col("ground_truth") == F.col("predicted"), F.col("n")).otherwise(0)
    per_label = (
        cells.select(*keys, hit.alias("hit"), F.posexplode(sides).alias("side", "s"))
        .groupBy(*keys, "s.label")
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.guessed").alias("guessed"),
            F.sum(F.when(F.col("side") == 0, F.col("hit"))).alias("hits"),
        )
        .withColumn("precision", ratio(F.col("hits"), F.col("guessed")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    total = F.sum("support")

    def weighted(name: str):
        return F.round(ratio(F.sum(F.col(name) * F.col("support")), total), 6).alias(name)

    return per_label.groupBy(*keys).agg(
        F.round(ratio(F.sum("hits"), total), 6).alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1")
    )


def prediction_counts(predictions: DataFrame, strategies: list[str], templates: list[str] = fv.TEMPLATES) -> DataFrame:
    """Predictions per strategy over a fixed template list, zero-filled, with their total."""
    counted = [
        F.count_if(F.coalesce(F.col("template") == name, F.lit(False))).alias(name) for name in templates
    ]
    total = sum((F.col(name) for name in templates[1:]), F.col(templates[0]))
    return long_predictions(predictions, strategies).groupBy("strategy").agg(*counted).withColumn("total", total)


def template_mix(responses: DataFrame, strategies: list[str], questions: str = "question_id") -> DataFrame:
    """Share of each template per strategy, strategies side by side."""
    counted = (
        responses.where(F.col("strategy").isin(strategies))
        .groupBy("strategy", F.coalesce("template", F.lit("unknown")).alias("template"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    share = percent(F.col("n"), F.sum("n").over(Window.partitionBy("strategy")))
    shares = counted.withColumn("share", share)
    columns = [
        F.coalesce(F.max(F.when(F.col("strategy") == name, F.col("share"))), F.lit(0.0)).alias(f"{name}_pct")
        for name in strategies
    ]
    return shares.groupBy("template").agg(*columns)


def routing_correlation(counts: DataFrame, first: str, second: str, templates: list[str] = fv.TEMPLATES) -> DataFrame:
    """Pearson correlation of two routers' template counts (rows of prediction_counts)."""
    long = counts.where(F.col("strategy").isin(first, second)).unpivot("strategy", templates, "template", "n")
    paired = long.groupBy("template").agg(
        F.max(F.when(F.col("strategy") == first, F.col("n"))).alias("a"),
        F.max(F.when(F.col("strategy") == second, F.col("n"))).alias("b"),
    )
    return paired.agg(F.round(F.corr(F.col("a").cast("double"), F.col("b").cast("double")), 6).alias("correlation"))


def average_by_strategy(rows: DataFrame, *measures: str) -> DataFrame:
    """Average of per-provider measures across providers."""
    return rows.groupBy("strategy").agg(*[F.round(F.avg(m), 4).alias(f"avg_{m}") for m in measures])


def model_comparison(scored: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Accuracy of several models; with ``timings`` (model, prediction_time) also speed."""
    table = scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg((F.col("ground_truth") == F.col("predicted")).cast("double")), 6).alias("accuracy"),
    )
    if timings is None:
        return table
    return table.join(timings, "model").withColumn(
        "avg_time_per_question", ratio(F.col("prediction_time"), F.col("questions"))
    )


def fold_gaps(fold_metrics: DataFrame) -> DataFrame:
    """Train minus validation accuracy per fold."""
    return fold_metrics.withColumn("gap", F.round(F.col("train_accuracy") - F.col("val_accuracy"), 6))


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of fold accuracy, mean F1 and gap, total time."""
    return fold_metrics.agg(
        F.round(F.avg("val_accuracy"), 6).alias("cv_mean_accuracy"),
        F.round(F.stddev_pop("val_accuracy"), 6).alias("cv_std_accuracy"),
        F.round(F.avg("val_f1"), 6).alias("cv_mean_f1"),
        F.round(F.avg(F.col("train_accuracy") - F.col("val_accuracy")), 6).alias("avg_gap"),
        F.round(F.sum("train_time"), 6).alias("total_time"),
    )


def improvement_over_reference(metrics: DataFrame, accuracy: str = "accuracy", reference: float = fv.REFERENCE_CV_ACCURACY) -> DataFrame:
    """Absolute and relative gain over a reference score, and what the gain saves."""
    gain = F.col(accuracy) - F.lit(reference)
    return (
        metrics.withColumn("improvement", F.round(gain, 6))
        .withColumn("improvement_pct", F.round(gain / F.lit(reference) * 100, 4))
        .withColumn(
            "savings_per_million",
            F.when(gain > 0, F.round(gain * 100 * fv.DOLLARS_PER_ACCURACY_POINT, 2)).otherwise(F.lit(0.0)),
        )
    )
