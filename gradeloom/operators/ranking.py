"""Exact ranks and running counts without one task per group.

A plain ``row_number() over (partition by group order by key)`` sends a whole group
to one task. Here every group is cut into many ordered buckets: bucket sizes are
counted with map-side combine, running totals over the bucket table give each bucket
its starting rank, and only then is a window used, inside one bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.session import per_group


#: Rows of a group that one task orders.
_BUCKET_ROWS = 100_000


def seeded_key(row_id: Column, seed: int) -> Column:
    """Reproducible shuffle key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")).cast("binary"))


def _bucket_starts(sized: DataFrame, group: str) -> DataFrame:
    """(group, bucket, n) plus ``start`` (rows in earlier buckets) and ``total``."""
    ordered = Window.partitionBy(group).orderBy("bucket")
    return sized.withColumn("start", F.sum("n").over(ordered) - F.col("n")).withColumn(
        "total", F.sum("n").over(Window.partitionBy(group))
    )


def stratified_split(
    rows: DataFrame,
    row_id: str,
    stratum: str,
    seed: int = 42,
    test_share: float = 0.2,
    validation_share: float = 0.1,
    hex_digits: int = 3,
) -> DataFrame:
    """Add ``split`` (train / val / test) with exact quotas inside every stratum; NULL is a stratum.

    Within a stratum rows are ordered by a seeded hash; the first round(test_share*n)
    are test, the next round(validation_share*n) val, the rest train. Only the two
    rows at the quota borders are looked for, so the wide rows are never shuffled:
    they are compared with two border keys per stratum.
    """
    narrow = rows.select(
        F.col(stratum).alias("g"), F.col(row_id).alias("rid"), seeded_key(F.col(row_id), seed).alias("key")
    ).withColumn("bucket", F.substring("key", 1, hex_digits))
    sized = narrow.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n"))
    test_quota = F.round(F.col("total") * F.lit(test_share)).cast("long")
    val_quota = F.round(F.col("total") * F.lit(validation_share)).cast("long")
    borders = (
        _bucket_starts(sized, "g")
        .withColumn("test_end", test_quota)
        .withColumn("val_end", test_quota + val_quota)
        .where(
            (F.col("start") < F.col("test_end")) & (F.col("start") + F.col("n") >= F.col("test_end"))
            | (F.col("start") < F.col("val_end")) & (F.col("start") + F.col("n") >= F.col("val_end"))
        )
        .select("g", "bucket", "start", "test_end", "val_end")
    )
    in_bucket = Window.partitionBy("g", "bucket").orderBy("key", "rid")
    near = per_group(borders).withColumnsRenamed({"g": "_g", "bucket": "_bucket"})
    ranked = narrow.join(near, F.col("g").eqNullSafe(F.col("_g")) & (F.col("bucket") == F.col("_bucket"))).withColumn(
        "rank", F.col("start") + F.row_number().over(in_bucket)
    )
    cuts = ranked.groupBy("g").agg(
        F.max(F.when(F.col("rank") == F.col("test_end"), F.struct("key", "rid"))).alias("test_cut"),
        F.max(F.when(F.col("rank") == F.col("val_end"), F.struct("key", "rid"))).alias("val_cut"),
    )
    own = F.struct(seeded_key(F.col(row_id), seed).alias("key"), F.col(row_id).alias("rid"))
    return (
        rows.join(
            per_group(cuts.withColumnRenamed("g", "_stratum")),
            F.col(stratum).eqNullSafe(F.col("_stratum")),
            "left",
        )
        .withColumn(
            "split",
            F.when(own <= F.col("test_cut"), "test").when(own <= F.col("val_cut"), "val").otherwise("train"),
        )
        .drop("_stratum", "test_cut", "val_cut")
    )


def hash_split(rows: DataFrame, row_id: str, seed: int = 42, test_share: float = 0.2, validation_share: float = 0.1) -> DataFrame:
    """Row-local variant of the split: no counting pass, shares hold on average."""
    draw = F.conv(F.substring(seeded_key(F.col(row_id), seed), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return rows.withColumn(
        "split",
        F.when(draw < test_share, "test").when(draw < test_share + validation_share, "val").otherwise("train"),
    )


def stratified_folds(
    rows: DataFrame,
    row_id: str,
    label: str,
    k: int = 3,
    seed: int = 42,
    hex_digits: int = 3,
) -> DataFrame:
    """Add ``fold`` in 0..k-1, dealing each label's rows round robin in seeded order; NULL is a label."""
    keyed = rows.withColumn("_key", seeded_key(F.col(row_id), seed)).withColumn(
        "_bucket", F.substring("_key", 1, hex_digits)
    )
    sized = keyed.groupBy(F.col(label).alias("g"), F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    starts = _bucket_starts(sized, "g").select(
        F.col("g").alias("_g"), F.col("bucket").alias("_b"), F.col("start").alias("_start")
    )
    starts = per_group(starts)
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_key", row_id)
    return (
        keyed.join(starts, F.col(label).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("fold", ((F.col("_start") + F.row_number().over(in_bucket) - 1) % k).cast("int"))
        .drop("_key", "_bucket", "_g", "_b", "_start")
    )


def _position(bounds: Column, value: Column, levels: int) -> Column:
    """Number of sorted bounds (2**levels - 1 of them) not above the value, by bisection."""
    steps = F.array(*[F.lit(2**i) for i in reversed(range(levels))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) <= value, at + step).otherwise(at),
    )


def running_counts(
    sized: DataFrame,
    group: str,
    order: str,
    count: str,
    levels: int | None = None,
) -> DataFrame:
    """Add ``running`` (inclusive running count in ``order``) and ``total`` per group; NULL is a group.

    ``sized`` has one row per (group, order value) with its row count, so a value shared
    by very many rows is already a single row. Groups are cut at approximate quantiles
    of ``order``; the quantiles only balance the buckets and are pinned, since another
    evaluation could place them differently. A group has 2**levels buckets; by default so
    many that the largest group has about ``_BUCKET_ROWS`` rows in each.
    """
    if levels is None:
        largest = sized.groupBy(group).count().agg(F.max("count")).first()[0] or 1
        levels = max(2, math.ceil(math.log2(max(1, largest / _BUCKET_ROWS))))
    parts = 2**levels
    shares = [i / parts for i in range(1, parts)]
    bounds = per_group(
        sized.groupBy(F.col(group).alias("_g")).agg(
            F.percentile_approx(order, shares, 100 * parts).alias("_bounds")
        )
    )
    placed = (
        sized.join(bounds, F.col(group).eqNullSafe(F.col("_g")))
        .withColumn("_bucket", _position(F.col("_bounds"), F.col(order), levels))
        .drop("_g", "_bounds")
    )
    totals = placed.groupBy(F.col(group).alias("g"), F.col("_bucket").alias("bucket")).agg(F.sum(count).alias("n"))
    starts = _bucket_starts(totals, "g").select(
        F.col("g").alias("_g"), F.col("bucket").alias("_b"), F.col("start").alias("_start"), "total"
    )
    starts = per_group(starts)
    inside = Window.partitionBy(group, "_bucket").orderBy(order)
    return (
        placed.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("running", F.col("_start") + F.sum(count).over(inside))
        .drop("_g", "_b", "_start", "_bucket")
    )
