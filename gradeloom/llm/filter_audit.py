"""How five filters interact: what each order of them keeps, removes and loses, per source.

Conditions: A under 200 words; B fewer than half of the words distinct; C over 2 % capitals A-Z; D one of ``#$%&*|``;
E the text equals one of a smaller doc_id. E is an existential self-join: a left-semi join on hash, exact text and smaller
doc_id marks the later rows. Only rows whose hash occurs again take part, so unique texts are never
shuffled, and the rows of large groups of copies are dealt over many tasks. The marks are united with the other failures
as a ledger of counts: a marked row leaves its combination of failures and enters the one with E.
So combinations, not rows, go on: 32 a source, which hold all that the 120 orders need.

Defined results: a null text is the empty text (it fails A alone, or E too); a null source is the part ''; a null doc_id is
smaller than none, so it neither fails E nor makes others fail; repeated rows count one by one and, having the same id, do not
make each other fail E; a document without labels is neither good nor toxic, one with several is either if any
says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import WORD, saved
from gradeloom.llm.repeats import hinted, spread
from gradeloom.session import computed_once

FILTERS = "ABCDE"
COPIED = 1 << FILTERS.index("E")
_SETS = 1 << len(FILTERS)


def failures(text: Column) -> Column:
    """Bits of the conditions A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))

    def bits(c: Column) -> Column:
        return F.when(c["n"] < 200, 1).otherwise(0) + F.when(100 * c["kinds"] < 50 * c["n"], 2).otherwise(0)

    loud = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), 4).otherwise(0)
    marked = F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    return (F.transform(counts, bits)[0] + loud + marked).cast("int")


def _with_failures(rows: DataFrame) -> DataFrame:
    keep = [c for c in rows.columns if c != "text"]
    return computed_once(rows, keep, failures(F.col("text")).alias("bits"))


def _copies(hashed: DataFrame, again: DataFrame, total: int) -> DataFrame:
    """(doc_id, part, bits) of the rows whose text equals that of a row with a smaller doc_id.

    ``again`` has the hashes that occur more than once and how often.
    """
    candidates = hinted(hashed, "hash", again).where("_maybe").drop("_maybe")
    own = saved(candidates.withColumn("_row", F.monotonically_increasing_id()), "copies")
    left, salted = spread(own, F.col("_row"), "hash", again, total)
    first = own.groupBy("hash", "text").agg(F.min("doc_id").alias("_first"))
    right = first.join(salted, "hash").select(F.col("hash").alias("_hash"), F.col("text").alias("_text"), F.col("_salt").alias("_other"), "_first")
    same = (F.col("hash") == F.col("_hash")) & (F.col("_salt") == F.col("_other")) & (F.col("text") == F.col("_text"))
    marked = left.join(right, same & (F.col("_first") < F.col("doc_id")), "left_semi")
    return _with_failures(marked.select("doc_id", "part", "text"))


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): how many documents fail exactly the filters in ``bits``."""
    hashed = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    narrow = saved(_with_failures(hashed), "failures")
    again = saved(narrow.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    moved = _copies(hashed, again, narrow.count()).select(
        "doc_id",
        "part",
        F.inline(F.array(F.struct(F.col("bits"), F.lit(-1).alias("change")), F.struct((F.col("bits") + COPIED).alias("bits"), F.lit(1).alias("change")))),
    )
    ledger = narrow.select("doc_id", "part", "bits", F.lit(1).alias("change")).unionByName(moved)
    counted = ledger.groupBy("doc_id", "part", "bits").agg(F.sum("change").alias("n")).where("n > 0")
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    labelled = counted.join(marks, "doc_id", "left")
    return labelled.groupBy("part", "bits").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"),
    )


def _passed(combined: DataFrame) -> DataFrame:
    """Per part a map from every set of filters (as bits) to the counts of documents that pass them all."""
    none = F.col("bits").bitwiseAND(F.col("set")) == 0
    sums = [F.sum(F.when(none, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    sets = combined.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(_SETS - 1)))).groupBy("part", "set").agg(*sums)
    return sets.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct("n", "good", "toxic")))).alias("passed"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1)
    before = F.aggregate(earlier, F.lit(0), lambda bits, x: bits + F.pow(F.lit(2), F.ascii(x) - ord("A")).cast("int"))
    own = F.pow(F.lit(2), F.ascii(letter) - ord("A")).cast("int")
    steps = (
        _passed(combinations(docs, labels))
        .withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .select("*", letter.alias("_letter"), own.alias("_own"), before.alias("_before"))
    )

    def count(of: Column, what: str = "n") -> Column:
        return F.col("passed")[of][what]

    after = F.col("_before") + F.col("_own")
    removed = count(F.col("_before")) - count(after)
    fails = count(F.lit(0)) - count(F.col("_own"))
    counted = steps.select(
        "part",
        "filter_order",
        "step",
        "_letter",
        count(after).alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        (count(F.lit(_SETS - 1) - F.col("_own")) - count(F.lit(_SETS - 1))).alias("unique_fails"),
        (count(F.col("_before"), "good") - count(after, "good")).alias("good_lost"),
        (count(F.col("_before"), "toxic") - count(after, "toxic")).alias("toxic_lost"),
    )
    same = Window.partitionBy("part", "_letter")  # 120 rows
    return counted.withColumn("shapley", F.sum("removed").over(same)).drop("_letter")
