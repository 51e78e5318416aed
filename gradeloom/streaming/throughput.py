"""Live progress: calls and tokens per provider, strategy and time window.

``throughput`` with ``write_windows`` keeps open windows as state and, as streams with a watermark do, drops what comes later.
``follow`` loses nothing: each micro-batch stores what it adds to the windows, the rows that were later than the watermark beside them, and
its counts; all that is stored can be added up, so a batch pass folds the late rows in whenever it is asked to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_KEYS = ["window_start", "provider", "strategy"]


def throughput(log: DataFrame, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Windowed counts and token sums; works on a stream and on a table alike.

    ``log`` has provider, strategy, success, tokens and completed_at (timestamp).
    """
    timed = log.withWatermark("completed_at", lateness) if log.isStreaming else log
    return (
        timed.groupBy(F.window("completed_at", window).alias("w"), "provider", "strategy")
        .agg(
            F.count(F.lit(1)).alias("completed"),
            F.count_if("success").alias("succeeded"),
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        )
        .select(F.col("w.start").alias("window_start"), "provider", "strategy", "completed", "succeeded", "tokens")
    )


def write_windows(windows: DataFrame, path: str, checkpoint: str):
    """Start the stream: every micro-batch writes its changed windows to its own folder.

    Replaying a batch overwrites the same folder, so a restart leaves no duplicates.
    """

    def store(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        windows.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """Newest state of every window written so far."""
    written = spark.read.parquet(path)
    rest = [c for c in written.columns if c not in (*_KEYS, "batch_id")]
    newest = F.max_by(F.struct(*rest), "batch_id")
    return written.groupBy(*_KEYS).agg(newest.alias("r")).select(*_KEYS, "r.*")


_SUMS = ["completed", "succeeded", "tokens"]
_BATCHES = "rows bigint, late bigint, latest timestamp, batch_id bigint"


def _batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(rows, late, latest, batch_id) of the stored batches, those before one if asked for."""
    try:
        stored = spark.read.schema(_BATCHES).option("basePath", f"{path}/batches").parquet(f"{path}/batches")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _BATCHES)
    return stored if before is None else stored.where(F.col("batch_id") < before)


def store_batch(log: DataFrame, batch_id: int, path: str, window: str, lateness: str) -> None:
    """Store one micro-batch: sums per window of the rows in time, the late rows, and the counts.

    A row is late if its whole window ended before the latest completion of earlier batches less ``lateness``. Every table has
    a folder a batch, which a replay overwrites; the counts come last, so a batch without them is not finished.
    """
    spark = log.sparkSession
    latest = _batches(spark, path, batch_id).agg(F.max("latest")).first()[0]
    border = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
    late = F.coalesce(F.window("completed_at", window)["end"] <= border, F.lit(False)).alias("_late")
    seen = Observation()
    counted = log.select("*", late).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late"), F.max("completed_at").alias("latest")
    )
    staged = f"{path}/rows/batch_id={batch_id}"
    counted.write.mode("overwrite").partitionBy("_late").parquet(staged)
    values = seen.get
    rows = spark.read.schema(log.schema.add("_late", "boolean")).parquet(staged) if values["rows"] else log.limit(0).withColumn("_late", F.lit(False))
    throughput(rows.where("NOT _late").drop("_late"), window).write.mode("overwrite").parquet(f"{path}/windows/batch_id={batch_id}")
    rows.where("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
    told = spark.createDataFrame([(values["rows"], values["late"], values["latest"])], "rows bigint, late bigint, latest timestamp")
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")


def follow(log: DataFrame, path: str, checkpoint: str, window: str = "1 minute", lateness: str = "10 minutes"):
    """Start a stream that stores windows, late rows and counts batch by batch."""
    return (
        log.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, path, window, lateness))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came later than the watermark, with their batch."""
    return spark.read.option("basePath", f"{path}/late").parquet(f"{path}/late")


def followed_windows(spark: SparkSession, path: str, window: str = "1 minute", with_late: bool = True) -> DataFrame:
    """The windows of all finished batches; with the late rows, they equal a pass over the whole log."""
    stored = spark.read.option("basePath", f"{path}/windows").parquet(f"{path}/windows").select(*_KEYS, *_SUMS, "batch_id")
    if with_late:
        late = late_rows(spark, path)
        stored = stored.unionByName(
            late.groupBy(F.window("completed_at", window).alias("w"), "provider", "strategy", "batch_id")
            .agg(F.count(F.lit(1)).alias("completed"), F.count_if("success").alias("succeeded"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
            .select(F.col("w.start").alias("window_start"), "provider", "strategy", *_SUMS, "batch_id")
        )
    finished = F.broadcast(_batches(spark, path).select(F.col("batch_id").cast("int").alias("batch_id")))  # one row a batch
    return stored.withColumn("batch_id", F.col("batch_id").cast("int")).join(finished, "batch_id", "left_semi").groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS])
