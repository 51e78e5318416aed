"""Reading question sets, run results, batch output, caches and listings.

Documents that hold a whole set in one JSON value are import formats. Indented results documents are read by
byte ranges (``sources.documents``); of the other kinds one document is one task. Sets written by
``sinks.writers`` are line-delimited or Parquet and split freely.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import schemas
from gradeloom.functions.messages import custom_id_question, custom_id_strategy
from gradeloom.operators.prepare import union_parts
from gradeloom.sources import documents

RUN_NUMBER = r"_n(\d+)_results\.json"


def read_question_documents(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Question documents to rows with position and the aligned embedding.

    ``multiline`` reads one pretty-printed document per file; otherwise every line is a
    document. Without an explicit number a question is numbered by its position.
    """
    docs = spark.read.schema(schemas.QUESTION_DOCUMENT).option("multiLine", multiline).json(path)
    vectors = F.coalesce("embeddings", F.array().cast("array<array<float>>"))
    exploded = docs.select(
        F.col("metadata.split").alias("split"),
        F.coalesce("metadata.first_question_id", F.lit(0)).alias("first"),
        F.posexplode(F.arrays_zip(F.col("questions").alias("q"), vectors.alias("e"))).alias("at", "z"),
    )
    fields = ["question", "subject", "category", "expected_template", "choices", "answer", "original_split"]
    return exploded.select(
        F.coalesce("z.q.question_id", F.col("first") + F.col("at")).alias("question_id"),
        "split",
        *[F.col(f"z.q.{f}").alias(f) for f in fields],
        F.col("z.e").alias("embedding"),
    )


def read_questions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Prepared questions; ``split`` prunes to one partition."""
    questions = spark.read.parquet(path)
    return questions if split is None else questions.where(F.col("split") == split)


def read_training_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_questions(spark, path, "train")


def read_corpus(spark: SparkSession, parts: dict[str, str]) -> DataFrame:
    """Raw corpus parts (name -> path) in one table with their origin."""
    return union_parts({name: spark.read.parquet(path) for name, path in parts.items()})


def read_results(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Results documents {provider: {strategy: [row]}} as flat response rows.

    A strategy with an empty list yields one row without a question, so that it still
    shows up in reports with a total of 0.
    """
    lines = spark.read.text(path, wholetext=whole_files)
    by_provider = lines.select(F.explode(F.from_json("value", schemas.RESULTS_DOCUMENT)).alias("provider", "by_strategy"))
    by_strategy = by_provider.select("provider", F.explode("by_strategy").alias("strategy", "rows"))
    return _response_rows(by_strategy.select("provider", "strategy", F.posexplode_outer("rows").alias("position", "r")))


def read_indented_results(spark: SparkSession, path: str, indent: int = 2) -> DataFrame:
    """Indented results documents as flat response rows, each file read by as many tasks as its size asks for."""
    return _response_rows(documents.read_indented(spark, path, schemas.RESPONSE, documents.RESULT_LEVELS, indent))


def read_indented_batch_results(spark: SparkSession, path: str, provider: str = "openai", indent: int = 2) -> DataFrame:
    """Indented batch results documents (no provider level) as response rows, read by ranges."""
    rows = documents.read_indented(spark, path, schemas.BATCH_RESPONSE, documents.BATCH_LEVELS, indent)
    return _response_rows(rows.withColumn("provider", F.lit(provider)), "choices", "answer", "category", "total_tokens")


def read_batch_results(spark: SparkSession, path: str, provider: str = "openai", whole_files: bool = False) -> DataFrame:
    """Batch results documents {strategy: [row]} (no provider level) as response rows.

    Rows without a question_id are numbered by their place in the list; where failed requests are left
    out of the list, that place is not the question's, and ``batch_responses`` over the raw lines is the way.
    """
    lines = spark.read.text(path, wholetext=whole_files)
    by_strategy = lines.select(F.explode(F.from_json("value", schemas.BATCH_RESULTS_DOCUMENT)).alias("strategy", "rows"))
    return _response_rows(
        by_strategy.select(F.lit(provider).alias("provider"), "strategy", F.posexplode_outer("rows").alias("position", "r")),
        "choices", "answer", "category", "total_tokens",
    )


def _response_rows(exploded: DataFrame, *more: str) -> DataFrame:
    fields = ["question", "template", "response", "success", "error", "attempts", "input_tokens", "output_tokens", *more]
    number = F.when(F.col("r").isNotNull(), F.coalesce("r.question_id", "position"))
    place = F.when(F.col("r").isNotNull(), F.col("position").cast("long"))
    return exploded.select(
        number.alias("question_id"), "provider", "strategy", *[F.col(f"r.{f}").alias(f) for f in fields], place.alias("position")
    )


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path: path, length, modificationTime (contents are not read)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
        .where(~F.endswith("path", F.lit("/")))
    )


def available_runs(spark: SparkSession, path: str, pattern: str = RUN_NUMBER) -> DataFrame:
    """Run numbers found in the names below a path, with the run's location."""
    number = F.regexp_extract("path", pattern, 1)
    return (
        list_objects(spark, path)
        .where(number != "")
        .select(number.cast("long").alias("n"), F.regexp_extract("path", rf"^(.*{pattern})", 1).alias("run"))
        .distinct()
    )


def choose_run(spark: SparkSession, path: str, n: int | None = None, pattern: str = RUN_NUMBER) -> str:
    """Location of the run with exactly ``n`` questions, or with the largest number."""
    runs = available_runs(spark, path, pattern)
    wanted = runs if n is None else runs.where(F.col("n") == n)
    row = wanted.orderBy(F.col("n").desc()).first()
    if row is None:
        known = [str(r.n) for r in runs.orderBy("n").limit(1001).collect()]
        listed = ", ".join(known[:1000]) + (" and more" if len(known) > 1000 else "")
        raise FileNotFoundError(f"no run with {n} questions in {path}; found: {listed}")
    return row.run


def read_predictions(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Router predictions; a missing path gives no rows.

    ``multiline`` reads one JSON array per file, the exchange format: its rows carry no number and are
    numbered by their place in the array. Otherwise every line is an object with its question_id.
    """
    try:
        if not multiline:
            return spark.read.schema(schemas.PREDICTION_ROW).json(path)
        files = spark.read.text(path, wholetext=True)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schemas.PREDICTION_ROW)
    rows = files.select(F.posexplode(F.from_json("value", f"array<struct<{_as_struct(schemas.PREDICTION_ROW)}>>")).alias("at", "r"))
    names = [part.split()[0] for part in schemas.PREDICTION_ROW.split(", ")]
    number = F.coalesce("r.question_id", F.col("at").cast("long")).alias("question_id")
    return rows.select(number, *[F.col(f"r.{n}").alias(n) for n in names[1:]])


def _as_struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ", 1) for part in ddl.split(", ")))


def read_batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """Batch output lines with question number, strategy, status, text and token usage."""
    lines = spark.read.schema(schemas.BATCH_RESULT_LINE).json(path)
    return parse_batch_lines(lines)


def parse_batch_lines(lines: DataFrame, *keep: str) -> DataFrame:
    usage = F.col("response.body.usage")
    content = F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]
    return lines.select(
        "custom_id",
        custom_id_question(F.col("custom_id")).alias("question_id"),
        custom_id_strategy(F.col("custom_id")).alias("strategy"),
        F.col("response.status_code").alias("status_code"),
        content.alias("response"),
        F.coalesce(usage["prompt_tokens"], F.lit(0)).alias("input_tokens"),
        F.coalesce(usage["completion_tokens"], F.lit(0)).alias("output_tokens"),
        F.coalesce(usage["total_tokens"], F.lit(0)).alias("total_tokens"),
        *keep,
    )


def accepted(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("status_code") == 200)


def rejected(lines: DataFrame) -> DataFrame:
    return lines.where(~F.coalesce(F.col("status_code") == 200, F.lit(False)))


def batch_responses(lines: DataFrame, questions: DataFrame) -> DataFrame:
    """Accepted batch lines joined with their questions, in the common response columns."""
    known = questions.select("question_id", "question", "choices", "answer", "category")
    return accepted(lines).join(known, "question_id").select(
        "question_id", F.lit("openai").alias("provider"), "strategy", "question", "choices", "answer", "category",
        F.lit("unknown").alias("template"), "response", F.lit(True).alias("success"),
        "input_tokens", "output_tokens", "total_tokens",
    )


def read_saved_questions(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Saved question list: (question_id, question) in list order."""
    docs = spark.read.schema(schemas.SAVED_QUESTIONS).option("multiLine", multiline).json(path)
    return docs.select(F.posexplode("questions").alias("question_id", "question"))


def read_question_list(spark: SparkSession, path: str) -> DataFrame:
    """The question list that ``writers.write_question_list`` saves, one row per question."""
    return spark.read.schema("question_id bigint, question string").json(f"{path}/questions")


def read_cache(spark: SparkSession, path: str, provider: str | None = None, question_id: int | None = None, multiline: bool = False) -> DataFrame:
    """Cached responses; ``provider`` prunes partitions, ``question_id`` looks one up."""
    entries = spark.read.schema(schemas.CACHE_ENTRY).option("multiLine", multiline).json(path)
    if provider is not None:
        entries = entries.where(F.col("provider") == provider)
    if question_id is not None:
        entries = entries.where(F.col("question_id") == question_id)
    return entries


def read_provider_results(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, list[str]]:
    """Response rows of the providers whose folder exists, and the names of the missing ones."""
    parts, missing = [], []
    for provider, path in paths.items():
        try:
            rows = spark.read.schema(schemas.RESPONSE_ROW).json(path)
        except Exception as absent:
            if "PATH_NOT_FOUND" not in str(absent):
                raise
            missing.append(provider)
            continue
        parts.append(rows.withColumn("provider", F.lit(provider)))
    merged = reduce(lambda a, b: a.unionByName(b), parts) if parts else None
    return merged, missing


def read_provider_documents(spark: SparkSession, path: str) -> DataFrame:
    """Single-document provider files {provider, ..., responses: [...]} as rows."""
    docs = spark.read.schema(schemas.PROVIDER_DOCUMENT).option("multiLine", True).json(path)
    return docs.select("provider", F.posexplode("responses").alias("position", "r")).select("provider", "position", "r.*")


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Batch tracker documents: one row per (tracker, strategy)."""
    docs = spark.read.schema(schemas.TRACKER).json(path)
    return docs.select("created_at", "num_questions", "provider", F.explode("strategies").alias("strategy", "job")).select(
        "created_at", "num_questions", "provider", "strategy", "job.*"
    )
