"""Reading large indented results documents by byte ranges.

A run of any size is one JSON value {group: {...: [row, row]}} that a serialiser has indented. Line breaks inside strings are
escaped there, so a line break, the indentation of a row and an opening brace only occur where a row begins. That sequence is
the record separator of Spark's text source, which deals a file's byte ranges to tasks; every row is parsed where it is read.

What groups a row belongs to stands in the text after some earlier row, maybe of another range. Those few places are carried
forward: within a range by intervals of row numbers, across ranges by one total a range. Only the interval table, which has
about as many rows as ranges and groups, is sorted; it is broadcast if it was counted to be small. The text is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom import schemas
from gradeloom.session import per_group, scratch_path

RESULT_LEVELS = ("provider", "strategy")
BATCH_LEVELS = ("strategy",)


def _name(quoted: Column) -> Column:
    """The text of a JSON string with its quotes."""
    return F.get(F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>"), F.lit(0))


def _events(tail: Column, levels: int, indent: int) -> Column:
    """Group names in the text between rows: level (from 0), name, and whether the group is empty, in order."""
    spaces = "|".join(" " * (indent * (k + 1)) for k in range(levels))
    line = rf'\n(?:{spaces})"(?:[^"\\]|\\.)*": ?[\[{{][\]}}]?'
    found = F.regexp_extract_all(tail, F.lit(line), F.lit(0))

    def event(text: Column) -> Column:
        before = F.length(F.regexp_extract(text, r"^\n( *)", 1))
        return F.struct(
            (before / indent - 1).cast("int").alias("level"),
            _name(F.regexp_extract(text, r'("(?:[^"\\]|\\.)*")', 1)).alias("name"),
            text.rlike(r"[\]}]$").alias("empty"),
        )

    return F.when(F.contains(tail, F.lit('"')), F.transform(found, event)).otherwise(F.array())


def _fixed_cuts(spark: SparkSession) -> SparkSession:
    """A session of the same settings whose reads cut files as they are cut now, whatever settings or cores change before they run."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name) or not name.startswith("spark."):
            own.conf.set(name, value)
    parts = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    own.conf.set("spark.sql.files.minPartitionNum", parts or str(spark.sparkContext.defaultParallelism))
    return own


def read_ranges(spark: SparkSession, path: str, levels: tuple[str, ...], indent: int = 2) -> tuple[DataFrame, DataFrame]:
    """The rows of the documents as (file, block, place, body), read anew whenever they are used, and (file, block, place, is_row, events, other), stored once.

    ``place`` numbers the rows of a range without gaps. Documents in another layout are one row each, with ``other`` set to their text.
    """
    margin = "\n" + " " * (indent * (len(levels) + 1))
    end = margin + "}"
    text = _fixed_cuts(spark).read.option("lineSep", margin + "{").text(path).select(
        "value",
        F.substring_index("value", end, 1).alias("body"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    # counted in bytes: positions in characters would go through every text again
    closed = F.octet_length("body") < F.octet_length("value")
    after = F.substring(F.col("value").cast("binary"), F.octet_length("body") + len(end) + 1, F.octet_length("value")).cast("string")
    tail = F.when(closed, after).otherwise(F.col("value"))
    known = closed | F.col("value").rlike(rf'^\{{(\}}|\n {{{indent}}}"|\n\}})')
    rows = text.select(
        "file",
        "block",
        "place",
        closed.alias("is_row"),
        F.when(known, _events(tail, len(levels), indent)).otherwise(F.array()).alias("events"),
        F.when(~known & (F.trim("value") != ""), F.col("value")).alias("other"),
    )
    target = scratch_path(spark, "ranges")
    rows.write.parquet(target, compression="zstd")
    return text.where(closed).select("file", "block", "place", "body"), spark.read.schema(rows.schema).parquet(target)


def _groups(rows: DataFrame, levels: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Intervals of row numbers with the names of their group and the rows of it before; and the groups without rows."""
    ordered = Window.partitionBy("file").orderBy("block", "place", "at")
    events = rows.where(F.size("events") > 0).select("file", "block", "place", F.posexplode("events").alias("at", "e"))
    names = [F.last(F.when(F.col("e.level") == k, F.col("e.name")), ignorenulls=True).over(ordered).alias(name) for k, name in enumerate(levels)]
    named = events.select("file", "block", "place", "at", "e.level", "e.empty", *names)
    leaves = named.where(F.col("level") == len(levels) - 1)
    opened = leaves.where("NOT empty").withColumn("group", F.struct("block", "place", "at", *levels))
    ranges = rows.groupBy("file", "block").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    starts = ranges.select("file", "block", (F.col("low") - 1).alias("place"), F.lit(-1).alias("at"), F.lit(None).cast(opened.schema["group"].dataType).alias("group"))
    marks = opened.select("file", "block", "place", "at", "group").unionByName(starts)
    carried = marks.withColumn("group", F.last("group", ignorenulls=True).over(ordered)).withColumn(
        "next", F.lead("place").over(Window.partitionBy("file", "block").orderBy("place", "at"))
    )
    bounded = carried.join(ranges, ["file", "block"]).where("group IS NOT NULL").select(
        "file", "block", F.col("place").alias("after"), F.coalesce("next", "high").alias("until"), "group"
    ).where("after < until")
    own = Window.partitionBy("file", "group").orderBy("block", "after").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.col("until") - F.col("after")).over(own), F.lit(0))
    intervals = bounded.select("file", "block", "after", "until", *[F.col(f"group.{name}").alias(name) for name in levels], earlier.alias("earlier"))
    return intervals, leaves.where("empty").select(*levels)


def read_indented(spark: SparkSession, path: str, row_type: str, levels: tuple[str, ...] = RESULT_LEVELS, indent: int = 2) -> DataFrame:
    """Rows of indented documents: the levels' names, ``position`` in its list and ``r``; an empty list gives one row without both.

    A document in any other layout is parsed as before, one file in one task. A document that breaks off within a
    row loses that row.
    """
    texts, rows = read_ranges(spark, path, levels, indent)
    intervals, empty = _groups(rows, levels)
    intervals = per_group(intervals).withColumnsRenamed({"file": "_file", "block": "_block"})
    inside = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")) & (F.col("place") > F.col("after")) & (F.col("place") <= F.col("until"))
    # parsed below the join, where one field's use cannot ask for a parse of its own
    parsed = texts.select("file", "block", "place", F.from_json(F.concat(F.lit("{"), "body", F.lit("}")), row_type).alias("r"))
    placed = intervals.join(parsed, inside).select(
        *levels, (F.col("earlier") + F.col("place") - F.col("after") - 1).cast("int").alias("position"), "r"
    )
    nothing = empty.select(*levels, F.lit(None).cast("int").alias("position"), F.lit(None).cast(row_type).alias("r"))
    return placed.unionByName(nothing).unionByName(_other_layouts(rows, row_type, levels))


def _other_layouts(rows: DataFrame, row_type: str, levels: tuple[str, ...]) -> DataFrame:
    """Documents that are not indented as expected: one JSON value, or one a line."""
    kind = f"array<{row_type}>"
    for _ in levels:
        kind = f"map<string, {kind}>"
    whole = F.from_json("other", kind)
    lines = F.transform(F.filter(F.split("other", "\n"), lambda t: F.trim(t) != ""), lambda t: F.from_json(t, kind))
    by_line = F.forall(lines, lambda d: d.isNotNull())
    documents = rows.where("other IS NOT NULL").select(F.explode(F.when(by_line, lines).otherwise(F.array(whole))).alias("d"))
    for name in levels:
        kept = [c for c in documents.columns if c != "d"]
        documents = documents.select(*kept, F.explode("d").alias(name, "d"))
    return documents.select(*levels, F.posexplode_outer("d").alias("position", "r"))
