"""From raw documents to shards: language, near copies, benchmark leaks, source mix, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; each result is
written to the shared folder as Parquet and read again. All stages but the last return the columns of
``documents``; the last adds each row's shard and slot to them, so that what comes out can be written as it is. Rows with null or
empty texts are rejected by the first stage, which finds no language in them; rows that share an id are told apart by
their text; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import decontaminate, language, mixing, near_dup, sharding
from gradeloom.llm.common import saved

LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language that most of their words share, and put it in ``lang``."""
    found = language.label(docs, docs.select("doc_id", "text", "lang"))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return near_dup.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of the benchmark."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the sources reach their target weights."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every row, with its text, into one of eight contiguous shards of nearly equal bytes."""
    return sharding.sharded(docs).select("row.*", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mix_sources", mix_sources),
    ("shards", shard),
]

#: Language labels, near copies and leaks are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
