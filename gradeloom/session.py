"""Session helpers: a scratch folder every executor can reach, and guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where the setting is absent, as in local tests, a temporary folder is made
    and recorded for the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="gradeloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read several times to the shared folder, where it outlives executors, and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint a small table so every later use sees the same rows.

    Used for approximate quantiles, whose value may differ when recomputed.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Rows up to which a table of one row per group is broadcast.
FEW_GROUPS = 100_000


def per_group(df: DataFrame, most: int = FEW_GROUPS) -> DataFrame:
    """A table with a few rows per group, evaluated once and broadcast if it has at most ``most`` rows.

    It is checkpointed and counted; a larger one is joined as adaptive execution sees fit.
    The rows are the same either way.
    """
    pinned = pin(df)
    return F.broadcast(pinned) if pinned.count() <= most else pinned


def computed_once(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """Select ``keep`` plus expensive columns that are evaluated exactly once per row.

    A filter on an ordinary derived column is pushed below its projection, which copies
    the whole expression into the filter (and nested ones many times over). Columns made
    by a generator stay where they are; filters on ``keep`` are still pushed to the scan.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
