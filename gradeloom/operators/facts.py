"""The classified response table that all quality measures read.

Text is reduced to a few small columns before anything is joined or shuffled, so the
response text itself never leaves the scan stage unless a report asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions import text as tx
from gradeloom.session import computed_once


def classify(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add ``stage`` (empty / error / valid), ``issue`` and ``answer``.

    ``answer`` is extracted from every text; ``stage`` tells whether it counts.
    """
    own = responses.columns
    prepared = (
        responses.withColumn("_body", tx.stripped(F.col(text)))
        .withColumn("_low", tx.folded(F.col("_body")))
        .withColumn("_head", tx.error_head(F.col(text)))
    )
    searched = computed_once(
        prepared,
        own,
        (F.coalesce("_body", F.lit("")) == "").alias("_blank"),
        tx.api_error(F.col(text), F.col("_body"), F.col("_head")).alias("_issue"),
        tx.answer_choice(F.col("_body"), F.col("_low")).alias("answer"),
    )
    return searched.select(
        *own,
        F.when(F.col("_blank"), "EMPTY_RESPONSE").otherwise(F.col("_issue")).alias("issue"),
        "answer",
        F.when(F.col("_blank"), "empty").when(F.col("_issue").isNotNull(), "error").otherwise("valid").alias("stage"),
    )


def grade(classified: DataFrame, answer_key: DataFrame | None, keep: list[str]) -> DataFrame:
    """Join the answer key: ``has_key`` and ``correct`` (NULL without a key or an answer).

    ``keep`` names the columns carried through the join; leave the text out of it.
    """
    slim = classified.select("question_id", *keep, "stage", "answer")
    if answer_key is None:
        return slim.withColumn("has_key", F.lit(False)).withColumn("correct", F.lit(None).cast("boolean"))
    key = answer_key.select(
        "question_id", tx.answer_letter(F.col("answer")).alias("key_letter"), F.lit(True).alias("in_key")
    )
    has_key = F.coalesce(F.col("in_key"), F.lit(False))
    return (
        slim.join(key, "question_id", "left")
        .withColumn("has_key", has_key)
        .withColumn(
            "correct",
            F.when(has_key & F.col("answer").isNotNull(), F.col("answer").eqNullSafe(F.col("key_letter"))),
        )
        .drop("in_key")
    )


def normalise(rows: DataFrame) -> DataFrame:
    """Success and failure rows in one schema; keys a failure row lacks become NULL."""
    wanted = {
        "question_id": "bigint",
        "question": "string",
        "strategy": "string",
        "template": "string",
        "provider": "string",
        "response": "string",
        "success": "boolean",
        "error": "string",
        "attempts": "int",
        "input_tokens": "int",
        "output_tokens": "int",
    }
    return rows.select(
        *[
            (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in wanted.items()
        ]
    )
