"""Merging provider results per question, the response cache, and failure lists.

Which row of a (provider, question) counts is decided on narrow rows, with aggregates that combine before the shuffle; texts are
attached afterwards, once. Copies of very frequent questions are dropped where they are read, so a question with
very many copies is no heavier than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.operators.prepare import lookup_table
from gradeloom.session import per_group, pin, stored

_FIELDS = ["question", "response", "success", "error", "attempts"]


#: A question is frequent with more rows than this and more than this share of all rows; so frequent ones are at most 1 / share.
FREQUENT_ROWS = 1000
FREQUENT_SHARE = 1e-4
_KEYS = ["provider", "question_id"]


def _matching(right: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """``right`` under other names, and the null-safe condition that joins it on ``columns``."""
    renamed = right.select(*[F.col(c).alias(f"_of_{c}") for c in columns], *[c for c in right.columns if c not in columns])
    return renamed, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns])


def _winners(rows: DataFrame) -> DataFrame:
    """(provider, question_id, position, contents) of the rows that come first, decided without their texts and stored.

    Rows are (provider, question_id, position, contents); of several at the first position the smallest ``contents`` wins.
    ``sharing`` is the number of rows at that position.
    """
    places = rows.groupBy(*_KEYS, "position").agg(F.min("contents").alias("contents"), F.count(F.lit(1)).alias("sharing"))
    best = places.groupBy(*_KEYS).agg(F.min("position").alias("position"))
    right, same = _matching(best, [*_KEYS, "position"])
    return stored(places.join(right, same, "left_semi"), "first-rows")


#: Largest bitmap of first rows, in bits (32 MB), and bits of one of its rows.
MOST_BITS = 1 << 28
SLOT_BITS = 1 << 15


def _likely_first(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows that may be winners, told where they are read by a broadcast bitmap: all winners, and few others.

    The bitmap has 16 bits a winner up to ``MOST_BITS``; with more winners than that it lets more rows through.
    """
    wanted = max(SLOT_BITS, 16 * winners.count())
    bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    place = F.pmod(F.xxhash64(*_KEYS, "position", "contents"), F.lit(bits))
    within = (place % SLOT_BITS).cast("int")
    bitmaps = (
        winners.select(F.floor(place / SLOT_BITS).alias("_slot"), within.cast("long").alias("_at"))
        .groupBy("_slot")
        .agg(F.bitmap_construct_agg("_at").alias("_bitmap"))
    )
    found = rows.join(F.broadcast(pin(bitmaps)), F.floor(place / SLOT_BITS) == F.col("_slot"))
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, (within % 8).cast("int")) == 1).drop("_slot", "_bitmap")


def _without_copies(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """``rows`` without those of frequent questions that are not first, dropped where they are read."""
    counted = pin(rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREQUENT_ROWS))
    total = rows.count() if not counted.isEmpty() else 0
    frequent = counted.where(F.col("n") > total * FREQUENT_SHARE).select(*_KEYS)  # at most 1 / FREQUENT_SHARE rows
    right, same = _matching(frequent, _KEYS)
    first, at = _matching(winners.join(F.broadcast(right), same, "left_semi"), [*_KEYS, "position", "contents"])
    kept = rows.join(F.broadcast(right.withColumn("_often", F.lit(True))), same, "left").drop(*right.columns)
    marked = kept.join(F.broadcast(first.withColumn("_first", F.lit(True))), at, "left").drop(*first.columns)
    return marked.where(F.col("_often").isNull() | F.col("_first").isNotNull()).drop("_often", "_first")


def _placed(responses: DataFrame, position: str) -> DataFrame:
    """Responses with ``position`` (last where there is none) and a hash of their contents."""
    place = F.coalesce(F.col(position).cast("long"), F.lit((1 << 63) - 1)).alias("position")
    return responses.select(*_KEYS, *_FIELDS, place, F.xxhash64(*_FIELDS).alias("contents"))


def first_response(responses: DataFrame, position: str) -> DataFrame:
    """The first row of every (provider, question_id) in ``position`` order; ties go to the smallest hash of the contents."""
    rows = _placed(responses, position)
    winners = _winners(rows)
    right, same = _matching(winners, [*_KEYS, "position", "contents"])
    firsts = _without_copies(_likely_first(rows, winners), winners).join(right, same, "left_semi").select(*_KEYS, *_FIELDS)
    return firsts if winners.where("sharing > 1").isEmpty() else firsts.distinct()


def question_outcomes(responses: DataFrame, providers: list[str], position: str) -> DataFrame:
    """Per question how many providers' first responses succeeded and failed.

    Only the success flag of the first response is carried, never its text.
    """
    flags = (
        responses.where(F.col("provider").isin(providers))
        .groupBy("question_id", "provider")
        .agg(F.min_by(F.coalesce("success", F.lit(False)), position).alias("ok"))
    )
    return flags.groupBy("question_id").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def on_spine(outcomes: DataFrame, total_questions: int) -> DataFrame:
    """All question numbers below ``total_questions``; those without a response are all-failed."""
    spine = outcomes.sparkSession.range(total_questions).withColumnRenamed("id", "question_id")
    return (
        spine.join(outcomes, "question_id", "left")
        .na.fill(0, ["succeeded", "failed"])
        .withColumn("all_failed", F.col("succeeded") == 0)
        .withColumn("partial_failure", (F.col("succeeded") > 0) & (F.col("failed") > 0))
    )


def merge_questions(firsts: DataFrame, providers: list[str]) -> DataFrame:
    """One row per question: its text and a provider -> response map.

    ``firsts`` holds at most one row per (provider, question), so the collected list has
    at most ``len(providers)`` entries. The text comes from the first listed provider that has it.
    """
    return _one_per_question(firsts.where(F.col("provider").isin(providers)), providers)


def merged_questions(responses: DataFrame, providers: list[str], position: str) -> DataFrame:
    """``merge_questions`` of the first responses, with one shuffle of the texts.

    The winners of a question are gathered as one narrow row, so the texts meet it on the question alone and stay there.
    """
    rows = _placed(responses.where(F.col("provider").isin(providers)), position)
    winners = _winners(rows)
    wanted = winners.groupBy(F.col("question_id").alias("_of_question_id")).agg(F.collect_list(F.struct("provider", "position", "contents")).alias("_wanted"))
    here = F.exists("_wanted", lambda w: (w["provider"] == F.col("provider")) & (w["position"] == F.col("position")) & (w["contents"] == F.col("contents")))
    met = _without_copies(_likely_first(rows, winners), winners).join(wanted, F.col("question_id") == F.col("_of_question_id")).where(here)
    return _one_per_question(met, providers)


def _one_per_question(rows: DataFrame, providers: list[str]) -> DataFrame:
    entry = F.struct(F.col("provider").alias("key"), F.col("question"), F.struct("response", "success", "error", "attempts").alias("value"))
    gathered = rows.groupBy("question_id").agg(F.collect_set(entry).alias("e"))  # equal rows of one place count once
    listed = F.transform(F.array(*[F.lit(p) for p in providers]), lambda p: F.get(F.filter("e", lambda x: x["key"] == p), F.lit(0)))
    ordered = gathered.select("question_id", F.filter(listed, lambda x: x.isNotNull()).alias("e"))
    texts = F.filter(F.col("e.question"), lambda text: text.isNotNull())
    return ordered.select(
        "question_id",
        F.get(texts, F.lit(0)).alias("question"),
        F.map_from_arrays("e.key", "e.value").alias("responses"),
    )


def named_rows(stored: DataFrame) -> DataFrame:
    """Rows of a Parquet table with the file (``_file``) and the place in it (``_at``) that name them."""
    return stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))


def latest_rows(named: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of named rows the last of every key in ``order``; ties go to the later file and place.

    Winners are found on narrow rows. What is left out is named by file and place; where that is little, as it mostly is, the
    table is not shuffled.
    """
    best = named.groupBy(*keys).agg(F.max(F.struct(*order, "_file", "_at")).alias("w")).select(F.col("w._file").alias("_file"), F.col("w._at").alias("_at"))
    older = per_group(named.select("_file", "_at").join(best, ["_file", "_at"], "left_anti"))
    return named.join(older, ["_file", "_at"], "left_anti").drop("_file", "_at")


def merge_statistics(spined: DataFrame) -> DataFrame:
    """How many questions failed everywhere or on some providers."""
    return spined.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if("all_failed").alias("all_failed"),
        F.count_if("partial_failure").alias("partial_failures"),
    )


def failure_rows(spined: DataFrame) -> DataFrame:
    """Question numbers behind the statistics, as rows rather than arrays."""
    kind = F.when(F.col("all_failed"), "all_failed").when(F.col("partial_failure"), "partial_failure")
    return spined.select("question_id", kind.alias("kind")).where(F.col("kind").isNotNull())


def provider_totals(responses: DataFrame) -> DataFrame:
    """Header of a provider results file: total, successful, failed."""
    ok = F.coalesce("success", F.lit(False))
    return responses.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
    )


def upsert_cache(current: DataFrame, incoming: DataFrame, keys: list[str] | None = None, version: str = "timestamp") -> DataFrame:
    """Last write per key; on equal timestamps the incoming row wins."""
    keys = keys or ["question_id", "provider"]
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    latest = F.max_by(F.struct(*rest), F.struct(version, "_new"))
    return both.groupBy(*keys).agg(latest.alias("r")).select(*keys, "r.*")


def pending_work(plan: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Planned calls that have no cached response yet."""
    return plan.join(cache.select(*keys), keys, "left_anti")


def failed_questions(responses: DataFrame, provider: str | None = None) -> DataFrame:
    """Distinct failed question numbers, sorted."""
    chosen = responses if provider is None else responses.where(F.col("provider") == provider)
    failed = chosen.where(~F.coalesce("success", F.lit(False)))
    return failed.select("question_id").distinct().orderBy("question_id")


def compare_question(cache: DataFrame, question_id: int, providers: list[str]) -> DataFrame:
    """All providers' cached responses to one question, in the given provider order."""
    rank = F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider"))
    return (
        cache.where((F.col("question_id") == question_id) & F.col("provider").isin(providers))
        .select("question_id", rank.alias("provider_no"), "provider", "question", "response", "success", "error")
    )


def merge_runs(parts: dict[str, DataFrame]) -> DataFrame:
    """Provider result sets in one table, tagged with their provider."""
    tagged = [df.withColumn("provider", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def missing_providers(spark: SparkSession, expected: list[str], found: DataFrame) -> DataFrame:
    """Expected providers without any row; each provider is looked at once per task."""
    wanted = lookup_table(spark, provider=expected)
    present = found.where(F.col("provider").isin(expected)).select("provider").distinct()
    return wanted.join(present, "provider", "left_anti")


def wrong_sizes(responses: DataFrame, expected: int) -> DataFrame:
    """Groups that do not hold the expected number of questions."""
    return (
        responses.groupBy("provider", "strategy")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") != expected)
    )


def strategies_per_provider(responses: DataFrame) -> DataFrame:
    """Number and sorted list of the strategies each provider has."""
    seen = responses.select("provider", "strategy").distinct()
    return seen.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n_strategies"),
        F.array_join(F.array_sort(F.collect_list("strategy")), ", ").alias("strategies"),
    )


def select_work(rows: DataFrame, provider: str | None = None, strategy: str | None = None) -> DataFrame:
    """Optional provider and strategy filters (partition columns on disk)."""
    for column, value in (("provider", provider), ("strategy", strategy)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows
