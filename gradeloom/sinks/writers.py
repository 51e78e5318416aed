"""Writing splits, run results, requests, reports, caches and question lists.

Row sets are written as rows in partitioned folders, never gathered into one document;
only small aggregated reports become a single nested value.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators.merge import provider_totals, upsert_cache
from gradeloom.operators.prepare import split_summary
from gradeloom.session import FEW_GROUPS, pin, scratch_path


def rebalanced(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows grouped by partition columns into evenly sized tasks.

    Without this every task writes a small file into every partition; adaptive execution
    splits large partitions, so a hot one is still written by many tasks.
    """
    return rows.hint("rebalance", *[F.col(c) for c in columns])


#: Files that a task keeps open at once, and the bytes of a Parquet row group while it does.
OPEN_FILES = 64
ROW_GROUP = 32 << 20
#: Pages are compressed on their own, so they hold as much as the codec's window can use; texts that are kept, at a higher level.
PAGES = {"compression": "zstd", "parquet.page.size": str(16 << 20)}
TEXTS = PAGES | {"parquet.compression.codec.zstd.level": "10"}


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Writes of few partitions that neither shuffle nor sort the rows: a task keeps one file per partition open.

    Beyond ``OPEN_FILES`` partitions a task sorts the rest of its rows, as it would otherwise do with all.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_splits(split: DataFrame, path: str, embedding: str | None = "embedding") -> None:
    """Questions partitioned by split, and one metadata row per split."""
    rebalanced(split, "split").write.mode("overwrite").partitionBy("split").parquet(f"{path}/questions")
    saved = split.sparkSession.read.parquet(f"{path}/questions")
    meta = split_summary(saved, embedding).select(
        "*",
        F.current_timestamp().cast("string").alias("generated_at"),
        F.lit(fv.SPLIT_STRATEGY).alias("split_strategy"),
    )
    meta.write.mode("overwrite").json(f"{path}/metadata")


def write_question_documents(questions: DataFrame, path: str) -> None:
    """Line-delimited question documents, one question each: no gathering, no shuffle."""
    entry = F.struct(
        "question_id", "question", "subject", "category", "expected_template", "choices", "answer", "original_split"
    )
    questions.select(
        F.struct(
            F.lit(1).cast("long").alias("total_questions"),
            "split",
            F.lit(fv.SPLIT_STRATEGY).alias("split_strategy"),
            F.size("embedding").alias("embedding_dim"),
            F.col("question_id").alias("first_question_id"),
        ).alias("metadata"),
        F.array(entry).alias("questions"),
        F.array("embedding").alias("embeddings"),
    ).write.mode("overwrite").json(path)


def write_results(responses: DataFrame, path: str, num_questions: int, format: str = "parquet") -> None:
    """Run results below num_questions= / provider= / strategy=; reruns replace only their partitions.

    The groups are few, and texts are written where they are read: one file per task and group.
    """
    with unsorted_writes(responses.sparkSession):
        (
            responses.withColumn("num_questions", F.lit(num_questions))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("parquet.block.size", ROW_GROUP)
            .options(**(TEXTS if format == "parquet" else {"compression": "gzip"}))
            .partitionBy("num_questions", "provider", "strategy")
            .format(format)
            .save(path)
        )


def results_documents(responses: DataFrame) -> DataFrame:
    """Line-delimited results documents {provider: {strategy: [row]}}, one row each.

    However often a question or group occurs, nothing is gathered and nothing is shuffled;
    the reader explodes documents with one row or with many alike.
    """
    row = F.struct(
        "question_id", "question", "strategy", "template", "provider", "response", "success", "error", "attempts",
        "input_tokens", "output_tokens",
    )
    nested = F.create_map(F.col("provider"), F.create_map(F.col("strategy"), F.array(row)))
    return responses.select(F.to_json(nested).alias("value"))


#: Characters of text that one indented document holds, about: one task sorts and writes it.
DOCUMENT_CHARS = 16 << 20
#: Level of compressed documents: half the time of the default one, which leaves 2 % less.
GZIP_LEVEL = "FIVE"


@contextmanager
def whole_files(spark: SparkSession) -> Iterator[None]:
    """Reads that cut no file: every task gets one file, whatever its size."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(1 << 50))
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def write_indented_results(responses: DataFrame, path: str, files: int = 1, indent: int = 2, compression: str = "none") -> None:
    """Run results as indented documents {provider: {strategy: [row]}}, the exchange format, in at least ``files`` files.

    A file is a whole document, so one task writes it. Several files of one run are what ``readers.read_indented_results``
    reads as one. A run of more than ``files`` times ``DOCUMENT_CHARS`` characters gets more files, so no task sorts much more than that;
    compressed files are then as good as plain ones to read.

    Texts are not shuffled. Each task stores its rows, encoded, in files that hold one document each; the rows that open and end a
    document's groups are found on the narrow columns, and each stored file is then sorted and written by the task that reads it.
    """
    spark = responses.sparkSession
    fields = [
        "question_id", "question", "strategy", "template", "provider", "response", "success", "error", "attempts",
        "input_tokens", "output_tokens",
    ]
    pad = [" " * (indent * k) for k in range(5)]

    plain = {f.name for f in responses.schema if f.dataType.simpleString() in ("bigint", "int", "boolean")}

    def encoded(name: str) -> Column:
        """The scalar column's value as JSON, which ends with no brace of its own."""
        if name in plain:
            return F.col(name).cast("string")
        return F.coalesce(F.rtrim(F.substring(F.to_json(F.struct(F.col(name).alias("v"))), 6, (1 << 31) - 1), F.lit("}")), F.lit(""))

    lines = [F.concat(F.lit(f'{pad[4]}"{f}": '), F.when(F.col(f).isNull(), "null").otherwise(encoded(f))) for f in fields]
    body = F.concat(F.lit(f"{pad[3]}{{\n"), F.concat_ws(",\n", *lines), F.lit(f"\n{pad[3]}}}"))
    keys = ["provider", "strategy", "question_id"]
    staged = scratch_path(spark, "document-rows")
    rows, most = responses, 0
    if files > 1:
        chars = sum(F.coalesce(F.sum(F.length(name)), F.lit(0)) for name in ("question", "response"))
        total, n = responses.agg(chars, F.count(F.lit(1))).first()
        # a task's last document may be a short one, so the others may hold half as much again
        most = max(1, min(-(-n // files), int(1.5 * n * DOCUMENT_CHARS) // max(total, 1)))
    else:
        rows = responses.coalesce(1)
    rows.select(*keys, body.alias("body")).write.option("maxRecordsPerFile", most).options(**PAGES).parquet(staged)
    stored_rows = spark.read.schema(f"provider string, strategy string, question_id {responses.schema['question_id'].dataType.simpleString()}, body string").parquet(staged).select(
        F.col("_metadata.file_name").alias("_file"), F.struct("question_id", F.col("_metadata.row_index").alias("row")).alias("_at"), "provider", "strategy", "body"
    )
    order = Window.partitionBy("_file").orderBy("provider", "strategy")
    around = {"_before": F.lag("provider").over(order), "_after": F.lead("provider").over(order), "_opens": F.row_number().over(order) == 1, "_more": F.lead(F.lit(True)).over(order)}
    groups = stored_rows.groupBy("_file", "provider", "strategy").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).withColumns(around)
    opens = F.col("_opens") | ~F.col("_before").eqNullSafe(F.col("provider"))
    more = F.coalesce("_more", F.lit(False))
    texts = groups.select(
        F.col("_file").alias("f"), F.col("provider").alias("p"), F.col("strategy").alias("s"), "_first", "_last",
        F.concat(
            F.when(F.col("_opens"), "{\n").otherwise(""),
            F.when(opens, F.concat(F.lit(pad[1]), encoded("provider"), F.lit(": {\n"))).otherwise(""),
            F.concat(F.lit(pad[2]), encoded("strategy"), F.lit(": [\n")),
        ).alias("_opening"),
        F.when(more & F.col("_after").eqNullSafe(F.col("provider")), f"\n{pad[2]}],")
        .when(more, f"\n{pad[2]}]\n{pad[1]}}},")
        .otherwise(f"\n{pad[2]}]\n{pad[1]}}}\n}}").alias("_ending"),
    )
    pinned = pin(texts)
    known = pinned.count()
    own = (F.col("_file") == F.col("f")) & F.col("provider").eqNullSafe(F.col("p")) & F.col("strategy").eqNullSafe(F.col("s"))
    if known <= FEW_GROUPS:
        dealt = stored_rows.join(F.broadcast(pinned), own)
    else:  # the join moves rows, so they are brought together again
        dealt = stored_rows.join(pinned, own).repartition(pinned.select("f").distinct().count(), "_file")
    value = F.concat(
        F.when(F.col("_at") == F.col("_first"), F.col("_opening")).otherwise(""), "body", F.when(F.col("_at") == F.col("_last"), F.col("_ending")).otherwise(",")
    )
    with whole_files(spark):
        text = dealt.sortWithinPartitions("_file", "provider", "strategy", "_at").select("_file", value.alias("value"))
        text.write.mode("overwrite").option("zlib.compress.level", GZIP_LEVEL).partitionBy("_file").text(path, compression=compression)


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    """One text line per row of the ``value`` column."""
    lines.select("value").write.mode("overwrite").text(path, compression=compression)


def write_predictions(predictions: DataFrame, counts: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(f"{path}/predictions")
    counts.write.mode("overwrite").json(f"{path}/prediction_counts")


def write_summary_csv(table: DataFrame, path: str) -> None:
    """A summary table (a few rows) as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def nested_report(rows: DataFrame) -> DataFrame:
    """{provider: {strategy: {...}}} of a per-group summary as one JSON value.

    ``rows`` has one row per (provider, strategy), so only group summaries are gathered.
    """
    values = [c for c in rows.columns if c not in ("provider", "strategy")]
    inner = rows.groupBy("provider").agg(
        F.map_from_entries(F.collect_list(F.struct("strategy", F.struct(*values).alias("v")))).alias("m")
    )
    outer = inner.agg(F.map_from_entries(F.collect_list(F.struct("provider", "m"))).alias("report"))
    return outer.select(F.to_json("report").alias("value"))


def write_cache(incoming: DataFrame, path: str, current: DataFrame | None = None) -> None:
    """Cache rows partitioned by provider, last write per (question, provider).

    The new state is written to its own folder; a cache is never overwritten while read.
    """
    state = incoming if current is None else upsert_cache(current, incoming)
    rebalanced(state, "provider").write.mode("overwrite").partitionBy("provider").json(path)


def write_provider_results(responses: DataFrame, path: str) -> None:
    """Per provider a header row (totals) and the response rows, in two folders.

    Rows are written compressed where they are read, one file per task and provider.
    """
    header = provider_totals(responses).withColumn("timestamp", F.current_timestamp().cast("string"))
    header.write.mode("overwrite").partitionBy("provider").json(f"{path}/header")
    with unsorted_writes(responses.sparkSession):
        responses.write.mode("overwrite").partitionBy("provider").json(f"{path}/responses", compression="gzip")


def write_question_list(questions: DataFrame, path: str) -> None:
    """Question list rows and a header with their number and the time."""
    questions.select("question_id", "question").write.mode("overwrite").json(f"{path}/questions")
    questions.agg(
        F.count(F.lit(1)).alias("total_questions"), F.current_timestamp().cast("string").alias("timestamp")
    ).write.mode("overwrite").json(f"{path}/header")
