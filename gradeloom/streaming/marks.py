"""Progress marks while a run goes on: every n-th completion of each provider and strategy, batch by batch.

What a group has completed so far is a small table with a folder per micro-batch. A batch reads the folder before its own, numbers its
completions from there on, in ordered buckets, so that one group is dealt over many tasks, and writes its marks and the
new totals. A replayed batch overwrites its own folders and starts from the same totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators.progress import progress_marks

_TOTALS = "provider string, strategy string, completed bigint, began bigint"


def _totals(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    if batch_id < 0:
        return spark.createDataFrame([], _TOTALS)
    return spark.read.schema(_TOTALS).parquet(f"{path}/totals/batch_id={batch_id}")


def mark_batch(log: DataFrame, batch_id: int, path: str, planned: DataFrame, step: int = fv.PROGRESS_STEP) -> None:
    """Write the marks of one micro-batch, whose completions are later than those of earlier ones, and the totals after it."""
    before = _totals(log.sparkSession, path, batch_id - 1)
    progress_marks(log, step, carried=before, planned=planned).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")
    own = log.groupBy("provider", "strategy").agg(F.count(F.lit(1)).alias("completed"), F.min(F.unix_micros("completed_at")).alias("began"))
    after = before.unionByName(own).groupBy("provider", "strategy").agg(F.sum("completed").alias("completed"), F.min("began").alias("began"))
    after.write.mode("overwrite").parquet(f"{path}/totals/batch_id={batch_id}")


def follow_marks(log: DataFrame, path: str, checkpoint: str, planned: DataFrame, step: int = fv.PROGRESS_STEP):
    """Start a stream of marks over a log of provider, strategy and completed_at; ``planned`` has each group's total."""
    return (
        log.writeStream.foreachBatch(lambda batch, number: mark_batch(batch, number, path, planned, step))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def all_marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/marks").drop("batch_id")
