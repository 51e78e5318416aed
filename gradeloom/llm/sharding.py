"""Contiguous shards of nearly equal byte size, cut from global prefix sums.

Defined results: a null text has size 1 and checksum 0; rows with a null id come first; repeated
rows keep their own slots; an empty table gives no rows; other columns of the input are ignored, so
they may have any name. Equal texts are not kept together: one group of copies may exceed a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import prefix_sums, saved


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of (doc_id, size, text_crc32, ...) with their shard and slot."""
    placed = saved(
        prefix_sums(rows, ["doc_id", "size", "text_crc32"], "size").withColumn(
            "shard", F.expr(f"CAST(((2 * before + size) * {int(shards)}) DIV (2 * total) AS INT)")
        ),
        "shards",
    )
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", (F.col("position") - F.col("first")).cast("long"))


def _checksum(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def balanced_shards(
    docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Documents are ordered by (id, size, checksum). A document belongs to the shard in which the middle of
    its byte range falls, so shards are contiguous and differ from the target by at most
    one document. ``slot`` counts from 0 within a shard.
    """
    text = F.col(text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), byte_size(text).alias("size"), _checksum(text).alias("text_crc32"))
    return _placed(rows, shards).select(
        F.col("doc_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row as the struct ``row`` with its size, text_crc32, shard and slot.

    Rows are numbered where they are stored, sorted without their texts, and joined by number, so ids may repeat.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stored = saved(packed.withColumn("_row", F.monotonically_increasing_id()), "rows")
    text = F.col(f"row.`{text_column}`")
    narrow = stored.select(F.col(f"row.`{id_column}`").alias("doc_id"), byte_size(text).alias("size"), _checksum(text).alias("text_crc32"), "_row")
    plan = _placed(narrow, shards).select("_row", "size", "text_crc32", "shard", "slot")
    return stored.join(plan, "_row").drop("_row")


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_column: str = "shard",
    slot_column: str = "slot",
) -> None:
    """Write the documents, one folder per shard, with their slots.

    Files are rebalanced, so a shard is written by as many tasks as its size asks for. The names of the two new columns must be free.
    """
    taken = {shard_column, slot_column} & set(docs.columns)
    if taken:
        raise ValueError(f"the documents have columns of their own named {sorted(taken)}; name others")
    placed = sharded(docs, shards, id_column, text_column)
    kept = placed.select("row.*", F.col("shard").alias(shard_column), F.col("slot").alias(slot_column))
    kept.hint("rebalance", shard_column).write.partitionBy(shard_column).parquet(path)
