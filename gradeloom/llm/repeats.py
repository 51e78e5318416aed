"""Keys that occur more than once: finding their rows without a shuffle, and joining them without a hot task.

``hinted`` marks the rows that may carry one of many keys, by a broadcast bitmap of bounded size; it never misses one, so
only those rows, and the few it marks by chance, have to be shuffled. ``spread`` deals the rows of very
frequent keys over several tasks. Results never depend on either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Largest bitmap, in bits (32 MB), and bits of a broadcast row.
MOST_BITS = 1 << 28
SLOT_BITS = 1 << 15
#: A key is frequent with more rows than this and more than this share of all rows; so there are at most 1 / share frequent keys.
FREQUENT_ROWS = 1000
FREQUENT_SHARE = 1e-4


def hinted(rows: DataFrame, key: str, keys: DataFrame, name: str = "_maybe") -> DataFrame:
    """``rows`` with a flag that is true for every row whose ``key`` is in ``keys`` (and, rarely, for others).

    The bitmap has 16 bits a key up to ``MOST_BITS``; with more keys than that it marks more rows by chance.
    """
    wanted = max(SLOT_BITS, 16 * keys.count())
    bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())
    place = F.pmod(F.xxhash64(key, F.lit(bits)), F.lit(bits))
    within = (place % SLOT_BITS).cast("int")
    bitmaps = (
        keys.select(F.floor(place / SLOT_BITS).alias("_slot"), within.cast("long").alias("_at"))
        .groupBy("_slot")
        .agg(F.bitmap_construct_agg("_at").alias("_bitmap"))
    )
    found = rows.join(F.broadcast(bitmaps), F.floor(place / SLOT_BITS) == F.col("_slot"), "left")
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (within % 8).cast("int")) == 1
    return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_slot", "_bitmap")


def spread(rows: DataFrame, row_key: Column, key: str, counted: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` and ``_salt``, with the rows of frequent keys dealt by ``row_key``.

    ``counted`` has one row per key and the number ``n`` of its rows among ``total``; those of frequent
    keys are repeated once a salt. The frequent keys are few by definition, so they are broadcast.
    """
    least = max(FREQUENT_ROWS, int(total * FREQUENT_SHARE))
    parts = F.ceil(F.col("n") / least).cast("int")
    frequent = counted.where(F.col("n") > least).select(F.col(key).alias("_frequent"), parts.alias("_parts"))
    left = rows.join(F.broadcast(frequent), F.col(key) == F.col("_frequent"), "left")
    salt = F.pmod(F.xxhash64(row_key), F.coalesce("_parts", F.lit(1))).cast("int")
    last = F.when(F.col("n") > least, parts - 1).otherwise(0)
    return left.withColumn("_salt", salt).drop("_frequent", "_parts"), counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
