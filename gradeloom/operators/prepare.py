"""Question preparation: subject mapping, template mapping, batches and distributions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.numbers import percent


def lookup_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A small lookup table as a local relation: the planner knows its exact size and
    decides from that whether to broadcast it."""
    return spark.createDataFrame(pa.table(columns))


def dimension(spark: SparkSession, mapping: dict, key: str, value: str) -> DataFrame:
    """A lookup dictionary as a two-column lookup table."""
    return lookup_table(spark, **{key: list(mapping.keys()), value: list(mapping.values())})


def subject_dimension(spark: SparkSession) -> DataFrame:
    return dimension(spark, fv.SUBJECT_CATEGORY, "subject", "category")


def template_dimension(spark: SparkSession) -> DataFrame:
    return dimension(spark, fv.CATEGORY_TEMPLATE, "category", "expected_template")


def union_parts(parts: dict[str, DataFrame], origin: str = "original_split") -> DataFrame:
    """One corpus out of named parts, each row tagged with the part it came from."""
    tagged = [df.withColumn(origin, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def map_subjects(questions: DataFrame, subjects: DataFrame) -> DataFrame:
    """Attach ``category``; questions of unknown subjects are dropped."""
    return questions.join(subjects, "subject")


def unmapped_questions(questions: DataFrame, subjects: DataFrame) -> DataFrame:
    """Audit of what ``map_subjects`` drops."""
    return questions.join(subjects, "subject", "left_anti")


def map_templates(questions: DataFrame, templates: DataFrame) -> DataFrame:
    """Attach the expected template of each question's category."""
    return questions.join(templates, "category")


def prepare_questions(raw: DataFrame) -> DataFrame:
    """Raw corpus to questions with category and expected template."""
    spark = raw.sparkSession
    return map_templates(map_subjects(raw, subject_dimension(spark)), template_dimension(spark))


def first_questions(questions: DataFrame, n: int) -> DataFrame:
    """The first ``n`` positions; a pushed-down filter, not a sort."""
    return questions.where(F.col("question_id") < n)


def with_embeddings(questions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Questions that have an embedding, with it."""
    return questions.join(embeddings, "question_id")


def with_batches(questions: DataFrame, size: int = 100) -> DataFrame:
    """Add the 1-based batch number and the first and last position of the batch."""
    batch = F.floor(F.col("question_id") / size)
    return (
        questions.withColumn("batch", batch + 1)
        .withColumn("batch_first", batch * size)
        .withColumn("batch_last", batch * size + (size - 1))
    )


def distribution(rows: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Count per key and its percentage of the total (or of the ``within`` group)."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if within:
        total = F.sum("n").over(Window.partitionBy(*within))
    else:
        total = rows.agg(F.count(F.lit(1))).scalar()
    return counted.withColumn("share_pct", percent(F.col("n"), total))


def split_summary(split: DataFrame, embedding: str | None = None) -> DataFrame:
    """Metadata row of each split: rows and embedding width."""
    width = F.max(F.size(embedding)) if embedding else F.lit(None).cast("int")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("total_questions"), width.alias("embedding_dim"))
