"""Evaluation tables derived from the given tables: questions, predictions, responses.

Documents become questions (their whole text), each with a subject, choices and an
answer; every mapped question gets one response per provider and strategy in one of 17
shapes, so every classification path occurs. All of it is row-local: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom import fixed_values as fv
from gradeloom.operators.prepare import prepare_questions

SUBJECT_NAMES = list(fv.SUBJECT_CATEGORY) + ["unlisted_one", "unlisted_two", "unlisted_three", "unlisted_four"]
N_SUBJECTS = len(SUBJECT_NAMES)
CATEGORIES = sorted(set(fv.CATEGORY_TEMPLATE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    base = "array(concat('first ', doc_id), concat('second ', n_chars), concat('third ', lang), 'none of these')"
    return documents.selectExpr(
        "doc_id AS question_id",
        "text AS question",
        f"get(split('{' '.join(SUBJECT_NAMES)}', ' '), CAST(doc_id % {N_SUBJECTS} AS INT)) AS subject",
        f"""CASE WHEN doc_id % 11 = 0 THEN CAST(array() AS array<string>)
            WHEN doc_id % 13 = 0 THEN concat({base}, array('extra 5', 'extra 6', 'extra 7')) ELSE {base} END AS choices""",
        "CASE WHEN doc_id % 17 <> 5 THEN CAST(doc_id % 4 AS INT) END AS answer",
        "get(array('dev', 'validation', 'test'), CAST(doc_id % 3 AS INT)) AS original_split",
        "n_chars",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_questions(questions_raw(spark, sf_dir))


def _routed(q: Column) -> dict[str, Column]:
    truth = F.col("expected_template")
    return {
        "baseline": F.lit("verbose"),
        "simple_neural": F.when(q % 10 == 3, "standard").otherwise(truth),
        "roberta": F.when(q % 9 == 4, "verbose").otherwise(truth),
    }


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide predictions; some ground truths are missing, as are some router outputs."""
    q = F.col("question_id")
    routed = _routed(q)
    return questions(spark, sf_dir).select(
        "question_id",
        "question",
        F.when(q % 29 != 7, F.col("expected_template")).alias("ground_truth"),
        routed["baseline"].alias("baseline"),
        F.when(q % 31 != 8, routed["simple_neural"]).alias("simple_neural"),
        F.when(q % 37 != 9, routed["roberta"]).alias("roberta"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = ", ".join(
        f"named_struct('provider', '{p}', 'pid', {pid}, 'strategy', '{s}', 'sid', {sid})"
        for pid, p in enumerate(fv.PROVIDERS)
        for sid, s in enumerate(fv.STRATEGIES)
    )
    planned = questions(spark, sf_dir).selectExpr(
        "question_id", "question", "answer", "n_chars", "expected_template", f"inline(array({work}))"
    )
    shaped = planned.selectExpr(
        "*",
        """substring('ABCD', CAST((coalesce(answer, 0) + CASE WHEN (question_id + pid + sid) % 4 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INT), 1) AS l""",
        "(question_id * 7 + pid * 3 + sid) % 17 AS k",
        """CASE WHEN (question_id * 7 + pid * 3 + sid) % 101 = 50 THEN NULL WHEN strategy = 'baseline' THEN 'verbose'
            WHEN strategy = 'simple_neural' AND question_id % 10 = 3 THEN 'standard'
            WHEN strategy = 'roberta' AND question_id % 9 = 4 THEN 'verbose' ELSE expected_template END AS template""",
    )
    response = F.expr(
        r"""CASE k
        WHEN 0 THEN concat('Answer: ', l, '\n', question)
        WHEN 1 THEN concat('**Answer: ', l, '**\n', question)
        WHEN 2 THEN concat('**Correct Letter:** ', l, '\n', question)
        WHEN 3 THEN concat('1. **Letter:** ', l, ' ', question)
        WHEN 4 THEN concat('correct letter  **', l, '**')
        WHEN 5 THEN concat('The correct answer is ', l, '. ', question)
        WHEN 6 THEN concat('1. ', l, ') ', question)
        WHEN 7 THEN concat('see (', l, ') above')
        WHEN 8 THEN concat('I choose option ', l, ' here')
        WHEN 9 THEN question
        WHEN 10 THEN ''
        WHEN 11 THEN concat('API Error: ', question)
        WHEN 12 THEN 'Rate limit exceeded, please retry'
        WHEN 13 THEN 'Hm.'
        WHEN 14 THEN 'Sorry, I cannot help with this request'
        WHEN 15 THEN NULL
        ELSE concat('\n answer: ', lower(l), ' ') END"""
    ).alias("response")
    return shaped.select("*", response).selectExpr(
        "question_id",
        "question",
        "provider",
        "strategy",
        "template",
        "response",
        "k <> 15 AS success",
        "CASE WHEN k = 15 THEN 'TimeoutError' END AS error",
        "CAST(CASE WHEN k = 15 THEN 20 ELSE 1 + question_id % 3 END AS INT) AS attempts",
        "CAST(CASE WHEN k <> 15 THEN 40 + n_chars % 90 END AS INT) AS input_tokens",
        """CAST(CASE WHEN k = 15 OR (k = 14 AND question_id % 7 = 0) THEN NULL
            WHEN k IN (4, 7, 8, 13, 14, 16) THEN 8 + question_id % 12
            ELSE least(CASE template WHEN 'minimal' THEN 50 WHEN 'standard' THEN 200 WHEN 'verbose' THEN 500
                WHEN 'technical' THEN 400 ELSE 150 END, 20 + n_chars) END AS INT) AS output_tokens""",
        "question_id * 3 + sid AS position",
    )


def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", "answer")


def question_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")


def router_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings labelled with a template, for training routers."""
    names = F.array(*[F.lit(t) for t in fv.TEMPLATES])
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.get(names, F.col("label") % 5).alias("template")
    )


def scored_predictions(spark: SparkSession, sf_dir: str, router: str = "simple_neural") -> DataFrame:
    """(ground_truth, predicted) of one router over all questions."""
    q = F.col("question_id")
    return questions(spark, sf_dir).select(
        "question_id", F.col("expected_template").alias("ground_truth"), _routed(q)[router].alias("predicted")
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of calls: provider, strategy, success, tokens, completed_at."""
    return log_columns(table(spark, sf_dir, "events"))


def log_columns(events: DataFrame) -> DataFrame:
    provider = F.get(F.array(*[F.lit(p) for p in fv.PROVIDERS]), (F.col("user_id") % 3).cast("int"))
    strategy = F.get(F.array(*[F.lit(s) for s in fv.STRATEGIES]), (F.col("event_id") % 3).cast("int"))
    return events.select(
        "event_id",
        provider.alias("provider"),
        strategy.alias("strategy"),
        (F.col("event_type") != "error").alias("success"),
        F.floor("value").cast("long").alias("tokens"),
        F.col("ts").cast("timestamp").alias("completed_at"),
    )
