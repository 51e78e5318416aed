"""The text report and the complete analysis of a response log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.numbers import percent, whole_average
from gradeloom.functions.text import likely_error, token_estimate
from gradeloom.operators import facts, quality, routing, usage
from gradeloom.session import stored
from gradeloom.sinks import writers

_KEYS = ["section", "provider", "strategy", "ord", "sub", "line"]


def _number(value: Column) -> Column:
    return F.format_number(value, 0)


def _line(section: int, ord_: int, line: Column, show: Column | None = None) -> Column:
    """One report line of the current row; a NULL line is not shown."""
    text = line if show is None else F.when(show, line)
    return F.struct(F.lit(section).alias("section"), F.lit(ord_).alias("ord"), text.alias("line"))


def _lines(rows: DataFrame, *lines: Column, sub: Column | None = None) -> DataFrame:
    """(section, provider, strategy, ord, sub, line) of each row; absent keys sort first."""

    def key(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit("")

    number = F.lit(0).cast("long") if sub is None else sub.cast("long")
    return (
        rows.select(
            key("provider").alias("provider"), key("strategy").alias("strategy"), number.alias("sub"), F.inline(F.array(*lines))
        )
        .where(F.col("line").isNotNull())
        .select(*_KEYS)
    )


def group_summary(responses: DataFrame) -> DataFrame:
    """Everything the report says about a provider and strategy, in one pass over the log."""
    ok = F.coalesce("success", F.lit(False))
    tokens = F.when(ok, quality.reported_tokens())
    answered = ok & (F.coalesce("response", F.lit("")) != "")
    slim = responses.select(
        "provider",
        "strategy",
        "question_id",
        ok.alias("ok"),
        tokens.alias("t"),
        F.when(answered, token_estimate(F.col("response"))).alias("estimate"),
        F.when(tokens < fv.LOW_TOKEN_LIMIT, F.lower("response")).alias("low_text"),
    )
    t = F.col("t")
    totals = slim.groupBy("provider", "strategy").agg(
        F.count("question_id").alias("total"),
        F.count_if("ok").alias("succeeded"),
        F.min("t").alias("min_tokens"),
        F.max("t").alias("max_tokens"),
        F.round(F.avg("t"), 1).alias("avg_tokens"),
        F.count_if(t < 20).alias("lt_20"),
        F.count_if((t >= 20) & (t < 100)).alias("to_100"),
        F.count_if((t >= 100) & (t < 300)).alias("to_300"),
        F.count_if(t >= 300).alias("ge_300"),
        F.count_if(likely_error(F.col("low_text"))).alias("likely_errors"),
        F.coalesce(F.sum("estimate"), F.lit(0)).alias("total_tokens"),
        F.count("estimate").alias("counted"),
    )
    return usage.with_savings(
        totals.withColumn("failed", F.col("total") - F.col("succeeded")).withColumn(
            "avg_estimate", whole_average(F.col("total_tokens"), F.col("counted"))
        )
    )


def report_lines(responses: DataFrame, predictions: DataFrame) -> DataFrame:
    """All report lines, unordered; every line comes from an aggregate of a few rows."""
    c = F.col
    issues = (c("failed") > 0) | (c("lt_20") > 0)
    groups = _lines(
        group_summary(responses),
        _line(1, 1, F.format_string("%s / %s: %d failed, %d below 20 tokens, %d of them look like errors",
              c("provider"), c("strategy"), c("failed"), c("lt_20"), c("likely_errors")), issues),
        _line(1, 3, F.format_string("  tokens min=%d avg=%.1f max=%d; <20: %d, 20-100: %d, 100-300: %d, >300: %d",
              c("min_tokens"), c("avg_tokens"), c("max_tokens"), c("lt_20"), c("to_100"), c("to_300"), c("ge_300")), issues),
        _line(4, 1, F.format_string("%s / %s: %s tokens (avg %d), saves %s (%.2f%%)", c("provider"), c("strategy"),
              _number(c("total_tokens")), c("avg_estimate"), _number(c("savings")), c("savings_pct"))),
        _line(5, 1, F.format_string("%s / %s: %d/%d (%.2f%%)", c("provider"), c("strategy"), c("succeeded"), c("total"),
              percent(c("succeeded"), c("total")))),
    )
    parts = [
        groups,
        _lines(
            quality.first_rows(quality.suspicious_responses(responses), quality.GROUP, "question_idx"),
            _line(1, 2, F.format_string("  Q%d: %d tokens - %s", c("question_idx"), c("output_tokens"), F.substring("response_preview", 1, 80))),
            sub=c("sample_no"),
        ),
        _lines(
            quality.run_header(responses),
            _line(2, 1, F.format_string("questions %d, providers %d, strategies %d, calls %d", c("questions"), c("providers"), c("strategies"), c("total_calls"))),
        ),
        _lines(
            routing.router_accuracy(predictions, responses),
            _line(3, 1, F.format_string("%s / %s: %.2f%% of predictions match (%d)", c("provider"), c("strategy"), c("accuracy_pct"), c("matches"))),
        ),
        _lines(
            routing.router_agreement(predictions, responses),
            _line(3, 2, F.format_string("%s: routers agree on %.2f%%", c("provider"), c("agreement_pct"))),
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ordered_report(lines: DataFrame) -> DataFrame:
    return lines.orderBy("section", "provider", "strategy", "ord", "sub")


def response_facts(responses: DataFrame, answer_key: DataFrame | None, *more: str) -> DataFrame:
    """Classified and graded rows without their text: what the quality measures need, and ``more`` columns."""
    return facts.grade(facts.classify(responses), answer_key, ["provider", "strategy", "template", *more])


def analyse(responses: DataFrame, predictions: DataFrame, answer_key: DataFrame | None) -> dict[str, DataFrame]:
    """Every table of the analysis. The graded facts are stored once for the tables built on them."""
    graded = stored(response_facts(responses, answer_key), "facts")
    per_group = quality.funnel_with_overall(graded)
    return {
        "success_rates": quality.success_rates(responses),
        "template_distribution": quality.template_distribution(responses),
        "validation_report": quality.validation_stats(responses),
        "suspicious_responses": quality.suspicious_responses(responses),
        "router_accuracy": routing.router_accuracy(predictions, responses),
        "router_agreement": routing.router_agreement(predictions, responses),
        "token_savings": usage.token_savings(responses),
        "router_comparison": routing.compare_strategies(responses),
        "funnel": quality.funnel_rates(per_group),
        "verdict": quality.dataset_verdict(per_group.where(F.col("provider") == "ALL")),
        "accuracy_by_template": quality.accuracy_by_template(graded),
        "summary_report": ordered_report(report_lines(responses, predictions)),
    }


def save_analysis(tables: dict[str, DataFrame], path: str) -> None:
    """Write the analysis: CSV for the two summary tables, JSON for the rest, text for the report."""
    for name in ("success_rates", "template_distribution"):
        writers.write_summary_csv(tables[name], f"{path}/{name}.csv")
    for name in ("validation_report", "token_savings", "router_accuracy"):
        writers.write_lines(writers.nested_report(tables[name]), f"{path}/{name}.json")
    for name in ("suspicious_responses", "router_agreement", "router_comparison", "funnel", "verdict", "accuracy_by_template"):
        tables[name].write.mode("overwrite").json(f"{path}/{name}")
    writers.write_lines(tables["summary_report"].select(F.col("line").alias("value")), f"{path}/summary_report.txt")
