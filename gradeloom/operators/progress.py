"""Progress of a run: every n-th completion with rate and remaining time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.numbers import ratio
from gradeloom.operators.ranking import running_counts
from gradeloom.session import per_group


def progress_marks(
    log: DataFrame,
    step: int = fv.PROGRESS_STEP,
    levels: int | None = None,
    carried: DataFrame | None = None,
    planned: DataFrame | None = None,
) -> DataFrame:
    """One row per ``step`` completions (and the last) of each provider and strategy; NULLs are groups too.

    ``log`` has provider, strategy and completed_at. Completions at the same instant are
    counted together first, and running counts are built from ordered buckets, so no
    group is sorted in a single task. ``carried`` has what was completed before this log (provider, strategy, completed, began in
    microseconds), ``planned`` how many completions a group will have in the end (provider, strategy, total); without it, the
    log is taken for all there will be.
    """
    group = F.struct("provider", "strategy").alias("grp")
    keyed = log.select(group, F.unix_micros("completed_at").alias("at"))
    sized = keyed.groupBy("grp", "at").agg(F.count(F.lit(1)).alias("n"))
    counted = running_counts(sized, "grp", "at", "n", levels)
    own = sized.groupBy(F.col("grp").alias("_grp")).agg(F.min("at").alias("began"), F.sum("n").alias("_own"), F.lit(0).cast("long").alias("_before"))
    if carried is not None:
        earlier = carried.select(group.alias("_grp"), "began", F.lit(0).cast("long").alias("_own"), F.col("completed").alias("_before"))
        own = own.unionByName(earlier).groupBy("_grp").agg(F.min("began").alias("began"), F.sum("_own").alias("_own"), F.sum("_before").alias("_before"))
    if planned is not None:
        wanted = planned.select(group.alias("_wanted"), F.col("total").alias("_planned"))
        own = own.join(wanted, F.col("_grp").eqNullSafe(F.col("_wanted")), "left").drop("_wanted")
    known = F.col("_before") + F.col("_own")
    ended = F.coalesce("_planned", known) if planned is not None else known
    groups = per_group(own.select("_grp", "began", "_before", ended.alias("_ended")))
    placed = counted.drop("total").join(groups, F.col("grp").eqNullSafe(F.col("_grp"))).select(
        "grp", "at", "n", (F.col("running") + F.col("_before")).alias("running"), F.col("_ended").alias("total"), "began"
    )
    first = F.floor((F.col("running") - F.col("n")) / step + 1) * step
    last = F.floor(F.col("running") / step) * step
    wide = step * 10_000
    none = F.array().cast("array<bigint>")
    # Long runs are exploded in two steps, so no array grows with the number of equal instants.
    chunks = F.when(first <= last, F.sequence(first, last, F.lit(wide).cast("long"))).otherwise(none)
    steps = F.sequence("chunk", F.least("last", F.col("chunk") + (wide - step)), F.lit(step).cast("long"))
    is_last = (F.col("running") == F.col("total")) & (F.col("total") % step != 0)
    ends = F.when(is_last, F.array(F.col("total"))).otherwise(none)
    marks = (
        placed.select("grp", "at", "total", "began", last.alias("last"), ends.alias("ends"), F.explode(F.concat(chunks, F.when(is_last, F.array(F.lit(-1).cast("long"))).otherwise(none))).alias("chunk"))
        .withColumn("completed", F.explode(F.when(F.col("chunk") < 0, F.col("ends")).otherwise(steps)))
        .select("grp", "at", "total", "began", "completed")
    )
    elapsed = (F.col("at") - F.col("began")) / F.lit(1e6)
    rate = ratio(F.col("completed"), elapsed) * 60
    return marks.select(
        "grp.provider",
        "grp.strategy",
        "completed",
        "total",
        F.round(elapsed, 3).alias("elapsed_sec"),
        F.round(rate, 3).alias("rate_per_min"),
        F.round(ratio(F.col("total") - F.col("completed"), rate), 3).alias("eta_min"),
    )
