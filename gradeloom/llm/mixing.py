"""Mix sources to target weights by repeating documents.

Defined results: a null or blank text has size 0 and is emitted like any other document of its
source; a null source is a source of its own, last in order; a null id is hashed as the text 'null'; an empty table gives no
rows; a source without words has target 0 and rate 0. Other input columns are carried by ``mix``
and ignored by ``copies``.

An id that occurs once is hashed alone. Rows that share an id are numbered in the order of (id, text, source) and
hashed with their number, so each is drawn on its own, and how many of several equal rows are taken does not depend on
where they are stored. Rows whose id a bitmap takes for a repeated one by chance are numbered, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import prefix_sums, saved, word_count
from gradeloom.llm.repeats import hinted

WEIGHTS = (5, 2, 1)
BROADCAST_SOURCES = 10_000


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2
) -> DataFrame:
    """Per source: source_size, target and rate, from rows of (source, size).

    Weights repeat over the sources in code-point order, null last. Sources that would exceed ``most`` times their
    size stop there and the excess goes to the others by weight. The level at which this
    settles is found in one pass over the sources ordered by size / weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = prefix_sums(
        totals.select("source", "source_size", F.col("source").isNull().alias("_null"), F.lit(1).alias("_one")),
        ["_null", "source"],
        "_one",
    ).drop("total", "before")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = ordered.select(
        "source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")
    ).withColumn("_ratio", F.col("cap") / F.col("weight"))
    by_cap = prefix_sums(weighed, ["_ratio", "source"], "cap").select(
        "source", "source_size", "weight", "cap", "_ratio", F.col("before").alias("cap_before"), F.col("total").alias("cap_total")
    )
    both = prefix_sums(by_cap, ["_ratio", "source"], "weight").withColumnsRenamed(
        {"before": "weight_before", "total": "weight_total"}
    )
    budget = F.col("cap_total") / F.lit(most) * F.lit(share)
    left = (budget - F.col("cap_before")) / (F.col("weight_total") - F.col("weight_before"))
    settled = saved(both.withColumn("level", left).withColumn("capped", F.col("_ratio") <= left), "levels")
    level = settled.where(~F.col("capped")).agg(F.min_by("level", F.struct("_ratio", "source"))).first()[0]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return settled.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def draw(id_column: Column, seed: int, number: Column | None = None) -> Column:
    """A number in [0, 1) that depends on the id, the seed and, where it is not null, the number alone."""
    text = F.concat(F.coalesce(id_column.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    if number is not None:
        text = F.concat(text, F.coalesce(F.concat(F.lit(":"), number.cast("string")), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of (id, text_key, ...) with ``number``: null where the id occurs once, else the place among all rows of repeated ids."""
    repeated = saved(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
    marked = hinted(rows, "id", repeated)
    again = saved(marked.where("_maybe").drop("_maybe").withColumn("_row", F.monotonically_increasing_id()), "again")
    keys = ["id", "text_key", "source"]
    places = prefix_sums(again.select(*keys, "_row", F.lit(1).alias("_one")), keys, "_one").select("_row", F.col("position").alias("number"))
    alone = marked.where("NOT _maybe").drop("_maybe").withColumn("number", F.lit(None).cast("long"))
    return alone.unionByName(again.join(places, "_row").drop("_row"))


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Attach the targets; few sources are broadcast, many are joined by adaptive execution."""
    targets = saved(targets, "targets").withColumnRenamed("source", "_target_source")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    return rows.join(targets, rows["source"].eqNullSafe(targets["_target_source"])).drop("_target_source")


def copies(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    floor(rate) copies, plus one where the row's hash falls below the fraction of the rate.
    """
    rows = saved(
        docs.select(
            F.col(id_column).alias("id"),
            F.xxhash64(text_column).alias("text_key"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
        ),
        "sizes",
    )
    placed = _with_targets(_numbered(rows), source_targets(rows.select("source", "size"), weights, share, most))
    whole = F.floor("rate")
    extra = (draw(F.col("id"), seed, F.col("number")) < F.col("rate") - whole).cast("long")
    return placed.withColumn("copies", whole + extra).select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mixed documents: every column of the input, each row as often as the mix takes it."""
    id_column, source = options.get("id_column", "doc_id"), options.get("source_column", "source")
    text = options.get("text_column", "text")
    settings = {k: v for k, v in options.items() if k in ("weights", "share", "most")}
    sizes = saved(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_column).alias("id"),
        F.xxhash64(text).alias("text_key"),
        F.col(source).alias("source"),
    )
    placed = _with_targets(_numbered(packed), source_targets(sizes, **settings))
    whole = F.floor("rate")
    extra = (draw(F.col("id"), seed, F.col("number")) < F.col("rate") - whole).cast("long")
    times = (whole + extra).cast("int")
    return placed.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")
