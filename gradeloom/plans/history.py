"""Statistics over many runs from stored partial states.

Each run leaves one small table: per provider and strategy the counts of its funnel and of its token classes, and a mergeable quantile
sketch of its tokens. Adding a run reads that run alone; statistics over any set of runs read only these tables. Counts, sums
and extremes are those of a pass over all responses; the median lies within the sketch's rank error of the true one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators.quality import GROUP, _FUNNEL, funnel, reported_tokens

#: Size of the sketch: with 4096 the rank of its median is off by about 0.1 %, by 0.4 % at worst.
SKETCH_K = 4096
RANK_ERROR = 0.004
_CLASSES = [("low_token_responses", None, fv.LOW_TOKEN_LIMIT), ("tokens_lt_20", None, 20), ("tokens_20_100", 20, 100), ("tokens_100_300", 100, 300), ("tokens_ge_300", 300, None)]


def run_state(graded: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Partial states of one run of classified responses (``facts``), one row per group."""
    ok = F.coalesce("success", F.lit(False))
    tokens = F.when(ok, reported_tokens())

    def within(low, high):
        keep = ok
        if low is not None:
            keep = keep & (reported_tokens() >= low)
        if high is not None:
            keep = keep & (reported_tokens() < high)
        return F.count_if(keep)

    return funnel(
        graded,
        keys,
        F.count_if(~ok).alias("failed_responses"),
        F.count(tokens).alias("counted"),
        F.coalesce(F.sum(tokens.cast("long")), F.lit(0)).alias("token_sum"),
        F.min(tokens).alias("min_tokens"),
        F.max(tokens).alias("max_tokens"),
        F.kll_sketch_agg_bigint(tokens.cast("long"), SKETCH_K).alias("sketch"),
        *[within(low, high).alias(name) for name, low, high in _CLASSES],
    )


def add_run(graded: DataFrame, path: str, run: str, keys: list[str] = GROUP) -> None:
    """Store a run's states; adding a run again replaces them."""
    run_state(graded, keys).coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}")


def across_runs(spark: SparkSession, path: str, runs: list[str] | None = None, keys: list[str] = GROUP) -> DataFrame:
    """Funnel counts and token statistics per group over the stored runs, all or the named ones."""
    states = spark.read.option("basePath", path).parquet(path)
    if runs is not None:
        states = states.where(F.col("run").cast("string").isin(runs))
    sums = [*_FUNNEL, "failed_responses", "counted", "token_sum", *[name for name, _, _ in _CLASSES]]
    merged = states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("min_tokens").alias("min_tokens"),
        F.max("max_tokens").alias("max_tokens"),
        F.kll_merge_agg_bigint(F.when(F.col("counted") > 0, F.col("sketch"))).alias("sketch"),
    )
    median = F.when(F.col("counted") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)))
    return merged.select(
        *keys,
        *[c for c in sums if c not in ("token_sum", "counted")],
        "min_tokens",
        "max_tokens",
        F.round(F.try_divide(F.col("token_sum"), F.col("counted")), 1).alias("avg_tokens"),
        median.alias("median_tokens"),
    )
