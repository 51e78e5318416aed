"""The consolidated output of a run: merged questions, failure lists and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.operators import merge


def consolidate(responses: DataFrame, providers: list[str], spine: DataFrame, position: str = "position") -> dict[str, DataFrame]:
    """Tables ``results`` (one row per expected question), ``failures`` (question_id, kind) and ``statistics`` (one row).

    ``spine`` has one row per expected question, as ``merge.on_spine`` gives it. The statistics
    hold the totals, the time, and a provider -> (successful, failed) map over the listed providers.
    """
    listed = responses.where(F.col("provider").isin(providers))
    per_provider = merge.provider_totals(listed).agg(
        F.map_from_entries(
            F.collect_list(F.struct("provider", F.struct("successful", "failed").alias("counts")))
        ).alias("by_provider")
    )  # at most one entry per listed provider
    statistics = merge.merge_statistics(spine).select(
        F.current_timestamp().cast("string").alias("generated_at"), "*", per_provider.scalar().alias("by_provider")
    )
    merged = merge.merged_questions(responses, providers, position)
    results = spine.select("question_id").join(merged, "question_id", "left")
    return {"results": results, "failures": merge.failure_rows(spine), "statistics": statistics}


def save_consolidated(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables as JSON lines, one folder each; the results, which hold the texts, are compressed. Failures are split by kind."""
    tables["results"].write.mode("overwrite").json(f"{path}/results", compression="gzip")
    tables["failures"].hint("rebalance", "kind").write.mode("overwrite").partitionBy("kind").json(f"{path}/failures")
    tables["statistics"].write.mode("overwrite").json(f"{path}/statistics")
