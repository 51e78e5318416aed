"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partition_count(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exclusive global running sum of ``value`` in the order of ``keys``, from per-partition totals.

    Adds ``before`` (sum of all earlier rows), ``position`` (gapless from 0) and ``total``.
    Rows are dealt by range with a tie-breaker, so no key, however frequent, fills a partition;
    each partition is summed on its own and shifted by the totals of the earlier ones. The
    totals have one row per partition. Nulls come first.
    """
    tied = saved(df.withColumn("_tie", F.monotonically_increasing_id()), "narrow")
    placed = saved(
        tied.repartitionByRange(*keys, "_tie").withColumn("_part", F.spark_partition_id()), "ranges"
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_sum").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    within = Window.partitionBy("_part").orderBy(*keys, "_tie")
    running = placed.withColumn(
        "_within", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn("_index", F.row_number().over(within))
    return (
        running.join(F.broadcast(offsets), "_part")
        .withColumn("before", F.col("_sum_before") + F.coalesce("_within", F.lit(0)))
        .withColumn("position", F.col("_rows_before") + F.col("_index") - 1)
        .drop("_tie", "_part", "_within", "_index", "_sum_before", "_rows_before")
    )
