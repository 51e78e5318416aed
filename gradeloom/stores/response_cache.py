"""A response cache keyed by (provider, question): bucketed Parquet that is looked up and merged bucket by bucket.

Entries lie below provider= / bucket=, the bucket being a hash of the question number. Files are sorted by question number, with a
Bloom filter on it, so a lookup reads one folder and in it at most the row groups that can hold the number. A merge reads
and rewrites only the buckets that new entries fall into. It chooses winners on narrow rows, so texts that lose are neither
sorted nor moved, and those that win are sorted within the tasks that read them, not shuffled.

The number of buckets is fixed when a cache is made and is found again in its folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.session import per_group, scratch_path
from gradeloom.sources.readers import list_objects

BUCKETS = 64
#: Stored bytes that one task of a merge sorts and writes, about.
TASK_BYTES = 32 << 20
#: Names of rows up to which they are broadcast, so that the texts they name stay where they are.
FEW_NAMES = 1 << 20
KEYS = ["provider", "question_id"]
#: Texts are most of a cache and are written rarely: a level above the codec's own 3.
_TEXTS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
#: Sizes that a file's Bloom filter is chosen from, halved from 1 MB; the writer's own 5 end at 64 KB, more than a small file's rows.
_BLOOM_SIZES = 12
_FIELDS = ["question_id", "question", "timestamp", "response", "success", "error", "attempts"]


def bucket_of(question_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(question_id), F.lit(buckets)).cast("int")


def _write(entries: DataFrame, path: str, tasks: int) -> None:
    """Replace the buckets that occur in ``entries``; each task sorts what it reads and writes one file a bucket.

    Spark's writer completes all new files in a folder of its own before it replaces the first bucket.
    """
    placed = entries.coalesce(tasks).sortWithinPartitions("provider", "bucket", "question_id")
    (
        placed.write.mode("overwrite")
        .options(partitionOverwriteMode="dynamic", **_TEXTS)
        .option("parquet.bloom.filter.enabled#question_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.bloom.filter.candidates.number#question_id", str(_BLOOM_SIZES))
        .partitionBy("provider", "bucket")
        .parquet(f"{path}/entries")
    )


def stored_bytes(spark: SparkSession, path: str) -> int:
    return list_objects(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def create(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """An empty cache: only its number of buckets."""
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/layout")


def bucket_count(spark: SparkSession, path: str) -> int:
    return spark.read.schema("buckets int").parquet(f"{path}/layout").first()["buckets"]


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries; a cache without any gives no rows."""
    schema = "question_id bigint, question string, timestamp timestamp, response string, success boolean, error string, attempts int, provider string, bucket int"
    try:
        return spark.read.schema(schema).parquet(f"{path}/entries")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def lookup(spark: SparkSession, path: str, provider: str, question_id: int, buckets: int | None = None) -> DataFrame:
    """The entry of one question and provider; one bucket's folder is read."""
    buckets = buckets or bucket_count(spark, path)
    number = spark.range(1).select(bucket_of(F.lit(question_id).cast("long"), buckets).alias("b")).first()["b"]
    wanted = (F.col("provider") == provider) & (F.col("bucket") == number) & (F.col("question_id") == question_id)
    return entries(spark, path).where(wanted).drop("bucket")


def upsert(spark: SparkSession, path: str, incoming: DataFrame, buckets: int | None = None) -> None:
    """Put entries into the cache: the last timestamp of a key wins, on equal timestamps the incoming row.

    Of incoming rows that agree in key and timestamp, one is taken by a hash of what they say, so replaying the same rows
    leaves the same cache. Buckets without a new winner keep their files. The merged buckets are complete before any file
    of the cache is replaced, so a merge that failed is repeated by calling it again.
    """
    buckets = buckets or bucket_count(spark, path)
    staged = scratch_path(spark, "incoming")
    contents = F.xxhash64("question", "response", "success", "error", "attempts").alias("_contents")
    numbered = incoming.select("provider", *_FIELDS, bucket_of(F.col("question_id"), buckets).alias("bucket"), contents, F.monotonically_increasing_id().alias("_row"))
    numbered.write.options(**_TEXTS).parquet(staged)
    new = spark.read.parquet(staged)

    place = ["provider", "bucket"]
    best = F.max(F.struct("timestamp", "_contents", "_row")).alias("w")
    firsts = new.groupBy(*place, "question_id").agg(best).select(*place, "question_id", "w.timestamp", "w._row")
    old = entries(spark, path)
    touched = per_group(firsts.select(*place).distinct())  # at most one row per provider and bucket
    known = old.join(touched, place, "left_semi").select(*place, "question_id", F.col("timestamp").alias("_old"))
    winners_path = scratch_path(spark, "winners")
    newer = F.col("_old").isNull() | (F.col("timestamp") >= F.col("_old"))
    firsts.join(known, [*place, "question_id"], "left").where(newer).select(*place, "question_id", "_row").write.parquet(winners_path)
    winners = spark.read.parquet(winners_path)

    changed = per_group(winners.select(*place).distinct())
    columns = [*_FIELDS, *place]
    replaced = old.join(changed, place, "left_semi")
    names = [*place, "question_id"]
    staying = per_group(replaced.select(*names).join(winners, names, "left_anti"), FEW_NAMES)
    few = staying.count() <= FEW_NAMES
    stay = (replaced.join(staying, names, "left_semi") if few else replaced.join(winners, names, "left_anti")).select(*columns)
    lost = per_group(new.select("_row").join(winners, "_row", "left_anti"), FEW_NAMES)
    come = new.join(lost, "_row", "left_anti").select(*columns)
    if winners.isEmpty():
        return
    bytes_in = sum(stored_bytes(spark, p) for p in ([staged] if few else [staged, f"{path}/entries"]))
    _write(stay.unionByName(come), path, max(1, -(-bytes_in // TASK_BYTES)))
