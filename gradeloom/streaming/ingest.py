"""Incremental ingestion of batch result files into a keyed response store.

Every micro-batch is a folder of its own. Compaction folds the batches so far into a new generation, with one row per custom id, and
then names that generation in a manifest. A reader opens the generation that the last manifest names and the batches after it.
Nothing is changed or removed by a compaction, so readers and a running ingestion are never disturbed; the folders that no
manifest needs any more are listed for the storage's clean-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import schemas
from gradeloom.operators.merge import latest_rows, named_rows
from gradeloom.sources.readers import list_objects, parse_batch_lines

_MANIFEST = "generation bigint, upto bigint"


def result_stream(spark: SparkSession, path: str, lateness: str = "1 hour") -> DataFrame:
    """New result lines as they arrive, re-delivered lines removed within the lateness."""
    lines = spark.readStream.schema(schemas.BATCH_RESULT_LINE).json(path)
    arrived = lines.select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    parsed = parse_batch_lines(arrived, "arrived")
    return parsed.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["custom_id"])


def store_stream(results: DataFrame, path: str, checkpoint: str):
    """Start ingestion: each micro-batch is written to its own folder (replays overwrite it)."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}", compression="zstd")

    return (
        results.writeStream.outputMode("append")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _folders(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(number, folder) of the complete folders ``name=number`` below a path; Spark marks a complete one with an empty file."""
    try:
        found = list_objects(spark, path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "number bigint, folder string")
    pattern = rf"^(.*/{name}=(\d+))/[^/]*$"
    return found.where(F.regexp_extract("path", pattern, 2) != "").select(
        F.regexp_extract("path", pattern, 2).cast("long").alias("number"), F.regexp_extract("path", pattern, 1).alias("folder")
    ).distinct()


def current_generation(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """The last generation that a manifest names, and the last batch in it."""
    try:
        named = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    last = named.orderBy(F.col("generation").desc()).first()
    return (last["generation"], last["upto"]) if last else None


def _open(spark: SparkSession, path: str) -> tuple[DataFrame | None, int | None, int]:
    """Stored rows of the last generation and the batches after it; the last batch; the generation's number."""
    known = current_generation(spark, path)
    generation, upto = known or (0, -1)
    newer = [r["folder"] for r in _folders(spark, f"{path}/batches", "batch_id").where(F.col("number") > upto).orderBy("number").collect()]
    parts = [named_rows(spark.read.parquet(f"{path}/generations/generation={generation}"))] if known else []
    if newer:
        own = spark.read.option("basePath", f"{path}/batches").parquet(*newer)
        parts.append(named_rows(own).withColumn("batch_id", F.col("batch_id").cast("long")))
        upto = max(int(f.rsplit("=", 1)[1]) for f in newer)
    if not parts:
        return None, None, generation
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), upto, generation


def _latest(spark: SparkSession, path: str) -> tuple[DataFrame | None, int | None, int]:
    stored, upto, generation = _open(spark, path)
    if stored is None:
        return None, None, generation
    return latest_rows(stored, ["custom_id"], ["arrived", "batch_id"]), upto, generation


def current_responses(spark: SparkSession, path: str) -> DataFrame:
    """Last stored line per custom id; reads the last generation and later batches only."""
    latest, _, _ = _latest(spark, path)
    if latest is None:
        raise FileNotFoundError(f"nothing is stored in {path}")
    return latest.drop("arrived", "batch_id")


def compact(spark: SparkSession, path: str) -> int | None:
    """Fold all complete batches into a new generation; its number, or None where there is nothing new.

    A compaction that failed before it wrote its manifest is repeated by the next one, which overwrites the same generation.
    """
    before = current_generation(spark, path)
    latest, upto, generation = _latest(spark, path)
    if latest is None or (before and upto == before[1]):
        return None
    number = generation + 1
    latest.write.mode("overwrite").parquet(f"{path}/generations/generation={number}", compression="zstd")
    named = spark.createDataFrame([(number, upto)], _MANIFEST)
    named.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return number


def obsolete_folders(spark: SparkSession, path: str, keep: int = 2) -> DataFrame:
    """Folders that the last ``keep`` generations and the batches after them do not need, for the storage's clean-up."""
    named = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.col("generation").desc()).limit(keep).collect()
    oldest = named[-1] if len(named) == keep else None
    if oldest is None:
        return spark.createDataFrame([], "folder string")
    batches = _folders(spark, f"{path}/batches", "batch_id").where(F.col("number") <= oldest["upto"])
    generations = _folders(spark, f"{path}/generations", "generation").where(F.col("number") < oldest["generation"])
    return batches.select("folder").unionByName(generations.select("folder"))
