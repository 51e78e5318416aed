"""Near-duplicate documents by HyperMinHash registers, banding and confirmation on full shingle sets.

A document is the set of its five-word shingles (A-Z lower-cased). For each of 128 buckets the smallest
of the shingles' hashes is kept as a compressed register: the number of leading zeros and the ten bits
after the leading one. Registers are banded; documents that agree in a whole band are candidates. The Jaccard index is
estimated from the equal registers, corrected for registers that agree by chance, and candidates
well below the threshold go. The rest are confirmed on the full sets.

Groups are never expanded into pairs. Equal sets form one class, of which one member goes on. In a band bucket, all
members are first compared with one leader. Buckets whose members are still in different components after that are cut into
blocks of bounded size, and the full sets go to the blocks: there a node is only compared with nodes of other
components, a link joins two components at once, and only the links that join any are returned, fewer than there are nodes. So no
connection between candidates is lost. Members of a bucket's largest component are not compared with each other at all.

Defined results: no text or no words: set size 0, linked with nothing; fewer than five words: one
shingle of all words; rows with a null id are linked with nothing and kept; repeated rows share a class;
an empty table gives no rows; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType

from gradeloom.llm.common import partition_count, saved
from gradeloom.llm.components import connected_components
from gradeloom.llm.repeats import hinted
from gradeloom.llm.tokens import blocks, rolling, word_hashes, words_of

WORDS = 5
THRESHOLD = (75, 100)
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
PAIR_BLOCK = 2048  # nodes of a part of a bucket; a block has one or two parts
PART_BYTES = 16_000_000  # and bytes of their sets
PACK_BYTES = 32_000_000  # of small blocks that are handed to a task together
BLOCK_BYTES = 3_000_000
_SLICE = 65_536
_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20)
_MULTIPLY = _RANDOM.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 2**63, REGISTERS, dtype=np.uint64)


#: Estimates below this are dropped: five standard errors under the threshold.
LEAST_ESTIMATE = 0.75 - 5 * (0.75 * 0.25 / REGISTERS) ** 0.5


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = words_of(text.lower() if text else None)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    return np.unique(_mixed(rolling(word_hashes(words), WORDS, _BASE)))


def compress(smallest: np.ndarray) -> np.ndarray:
    """Registers of 16 bits: six for the leading zeros, ten for what follows the leading one."""
    zeros = np.zeros(smallest.shape, np.uint64)
    rest = smallest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = rest < (np.uint64(1) << np.uint64(64 - step))
        zeros[low] += np.uint64(step)
        rest[low] <<= np.uint64(step)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((np.minimum(zeros, np.uint64(63)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers of non-empty sets, one row each."""
    out = np.empty((len(sets), REGISTERS), np.uint64)
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= _SLICE):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[at:stop])
        starts = np.cumsum([0, *(len(s) for s in sets[at : stop - 1])])
        scratch = np.empty_like(flat)
        for k in range(REGISTERS):
            np.bitwise_xor(flat, _FLIP[k], out=scratch)
            np.multiply(scratch, _MULTIPLY[k], out=scratch)
            out[at:stop, k] = np.minimum.reduceat(scratch, starts)
        at = stop
    return compress(out)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that the registers of two unrelated sets of n and m shingles agree."""
    total = np.zeros(len(n))
    for zeros in range(63):
        upper, lower = 1 - 2.0 ** -(zeros + 1), 1 - 2.0**-zeros
        total += (upper**n - lower**n) * (upper**m - lower**m)
    return total / (1 << MANTISSA)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard index from the share of equal registers, without those equal by chance."""
    by_chance = chance(np.asarray(n, float), np.asarray(m, float))
    return (equal - by_chance) / (1 - by_chance)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        sets = [shingles(t) for t in block.column("text").to_pylist()]
        full = [k for k, s in enumerate(sets) if len(s)]
        registers = signatures([sets[k] for k in full]) if full else []
        keys, signed = [None] * len(sets), [None] * len(sets)
        for k, row in zip(full, registers):
            keys[k], signed[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "set_key", "signature"],
        )


def describe(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text, text_key): set size, 128-bit hash of the set, registers."""
    return docs.mapInArrow(_describe, "doc_id long, text_key long, n_shingles long, set_key binary, signature binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        sets = [s.tobytes() for s in map(shingles, block.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "set_key", "members"])


def _matrix(column, kind=np.uint16) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


@F.pandas_udf(DoubleType())
def _estimated(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    return pd.Series(estimate((_matrix(a) == _matrix(b)).mean(axis=1), n, m))


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b))
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs], dtype="int64")


class _Block:
    """The nodes of one block of a bucket, with registers, full sets and components."""

    def __init__(self, table: pa.Table):
        self.node, self.component, self.part, self.band = (table.column(c).to_numpy() for c in ("node", "component", "part", "band"))
        self.one_part = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        self.signature = _matrix(table.column("signature").to_pylist())
        sets = [np.frombuffer(m, np.uint64) for m in table.column("members").to_pylist()]
        self.size = np.array([len(m) for m in sets])
        self.end = np.cumsum(self.size)
        kinds, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(kinds), bool)

    def _common(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles node i has in common with each of the others."""
        own = self.code[self.end[i] - self.size[i] : self.end[i]]
        self.mark[own] = True
        sizes = self.size[others]
        first = np.cumsum(sizes) - sizes
        place = np.arange(first[-1] + sizes[-1]) - np.repeat(first - (self.end[others] - sizes), sizes)
        hits = np.add.reduceat(self.mark[self.code[place]].astype(np.int64), first)
        self.mark[own] = False
        return hits

    def forest(self) -> tuple[list[int], list[int]]:
        """Links that join components, fewer than there are components; what they connect is all that any link would.

        A pair that meets in several buckets counts where its first common band is.
        """
        low, high = [], []
        component = np.unique(self.component, return_inverse=True)[1]
        biggest = np.bincount(component).argmax()
        waiting = component == biggest  # partners that have had, or need, no turn of their own
        for i in np.flatnonzero(component != biggest):
            others = component != component[i]
            others &= waiting if self.one_part else self.part != self.part[i]
            others &= 100 * np.minimum(self.size, self.size[i]) >= 75 * np.maximum(self.size, self.size[i])
            waiting[i] = True
            others = np.flatnonzero(others)
            equal = self.signature[others] == self.signature[i]
            own = equal.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1) == self.band[i]
            own &= estimate(equal.mean(axis=1), np.full(len(others), self.size[i]), self.size[others]) >= LEAST_ESTIMATE
            others = others[own]
            if not len(others):
                continue
            common = self._common(i, others)
            linked = others[THRESHOLD[1] * common >= THRESHOLD[0] * (self.size[others] + self.size[i] - common)]
            joined, one = np.unique(component[linked], return_index=True)
            low += [int(self.node[i])] * len(joined)
            high += self.node[linked[one]].tolist()
            component[np.isin(component, joined)] = component[i]
        return low, high


def _forests(table: pa.Table) -> pa.Table:
    """The forests of all blocks of one pack."""
    table = table.sort_by([("bucket", "ascending"), ("low", "ascending"), ("high", "ascending")])
    bucket, first, last = (table.column(c).to_numpy() for c in ("bucket", "low", "high"))
    starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])])
    a, b = [], []
    for start, stop in zip(starts, np.r_[starts[1:], len(bucket)]):
        low, high = _Block(table.slice(start, stop - start)).forest()
        a += low
        b += high
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _members(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, members): the full sets of some nodes, from the texts of their smallest ids."""
    own = nodes.join(wanted, "node").select("node", "set_key", F.col("doc_id").alias("_id"))
    texts = docs.join(own.select(F.col("_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "doc_id long, set_key binary, members binary")
    # A repeated id may stand for several texts: the key of the set tells them apart.
    return sets.join(own, "set_key").where("doc_id = _id").groupBy("node").agg(F.any_value("members").alias("members"))


def _confirmed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose full sets are similar enough."""
    both = pairs.join(members.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a").join(
        members.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b"
    )
    sizes = (F.octet_length("set_a") + F.octet_length("set_b")) / 8
    counted = both.select("a", "b", sizes.alias("sizes"), _common("set_a", "set_b").alias("common"))
    return counted.where(THRESHOLD[1] * F.col("common") >= THRESHOLD[0] * (F.col("sizes") - F.col("common"))).select("a", "b")


def _bucket_keys(signature: Column) -> Column:
    """(band, bucket) of every band."""
    width = 2 * ROWS
    return F.array(
        *[F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), F.substring(signature, k * width + 1, width)).alias("bucket")) for k in range(BANDS)]
    )


def _cross_component(shared: DataFrame, nodes: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) that join the components within each bucket.

    A bucket is cut into parts by a hash of the node, its largest component apart from the rest. Each part of the rest meets
    every part; parts of the largest component do not meet each other.
    """
    signed = nodes.select("node", "n_shingles", "signature")
    labelled = saved(
        shared.select("band", "bucket", "node")
        .join(labels, "node", "left")
        .join(signed.select("node", "n_shingles"), "node")
        .withColumn("component", F.coalesce("component", "node")),
        "labelled",
    )
    bytes_ = 8 * F.col("n_shingles")
    groups = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("nodes"), F.sum(bytes_).alias("bytes"))
    mixed = (
        groups.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("components"),
            F.max(F.struct("nodes", "component", "bytes")).alias("big"),
            F.sum("nodes").alias("nodes"),
            F.sum("bytes").alias("bytes"),
        )
        .where("components > 1")
    )

    def parts(count, size):
        return F.greatest(F.ceil(count / PAIR_BLOCK), F.ceil(size / PART_BYTES)).cast("int")

    sized = mixed.select(
        "bucket",
        F.col("big.component").alias("biggest"),
        "bytes",
        parts(F.col("nodes"), F.col("bytes")).alias("all_parts"),
        parts(F.col("nodes") - F.col("big.nodes"), F.col("bytes") - F.col("big.bytes")).alias("rest_parts"),
        parts(F.col("big.nodes"), F.col("big.bytes")).alias("big_parts"),
    )
    small = F.col("all_parts") == 1
    of_rest = F.col("component") != F.col("biggest")
    own_parts = F.when(small, 1).when(of_rest, F.col("rest_parts")).otherwise(F.col("big_parts"))
    part = F.pmod(F.xxhash64("node"), own_parts).cast("int") + F.when(small | of_rest, 0).otherwise(F.col("rest_parts"))
    last = F.when(small, 0).when(of_rest, F.col("rest_parts") + F.col("big_parts") - 1).otherwise(F.col("rest_parts") - 1)
    placed = saved(
        labelled.join(sized, "bucket")
        .withColumns({"part": part, "other": F.explode(F.sequence(F.lit(0), last)), "small": small})
        .select("band", "bucket", "node", "component", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "small"),
        "blocks",
    )
    total = placed.join(signed, "node").where("small").agg(F.sum(bytes_ + 2 * REGISTERS)).first()[0] or 0
    packs = max(partition_count(shared), total // PACK_BYTES)
    pack = F.when(F.col("small"), F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.xxhash64("bucket", "low", "high"))
    full = placed.join(members, "node").join(signed.select("node", "signature"), "node").withColumn("pack", pack)
    return full.groupBy("pack").applyInArrow(_forests, "a long, b long")


def _judged(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, text_key) as doc_id, text_key, n_shingles, component and component_id; both are null without links."""
    described = saved(describe(rows), "signatures")
    classes = described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature")
    )
    nodes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = nodes.select("node", F.inline(_bucket_keys(F.col("signature"))))
    crowded = keyed.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    shared = saved(keyed.join(crowded, "bucket"), "buckets")
    members = saved(_members(rows, nodes, shared.select("node").distinct()), "sets")

    stars = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    signed = nodes.select("node", "n_shingles", "signature")
    promising = (
        stars.join(signed.withColumnsRenamed({"node": "a", "n_shingles": "n", "signature": "sig_a"}), "a")
        .join(signed.withColumnsRenamed({"node": "b", "n_shingles": "m", "signature": "sig_b"}), "b")
        .where(_estimated("sig_a", "n", "sig_b", "m") >= LEAST_ESTIMATE)
        .select("a", "b")
    )
    first = saved(connected_components(_confirmed(saved(promising, "pairs"), members)), "components")
    links = saved(_cross_component(shared, nodes, members, first), "links")
    merged = connected_components(_between(links, first))
    labels = first.join(merged.select(F.col("node").alias("component"), F.col("component").alias("merged")), "component", "left").select(
        "node", F.coalesce("merged", "component").alias("component")
    ).union(
        merged.join(first.select("node"), "node", "left_anti").select("node", "component")
    )
    placed = nodes.select("set_key", "node", "doc_id").join(saved(labels, "components"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    named = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = placed.join(named, "component").select("set_key", "component", "component_id")
    return described.drop("signature").join(by_set, "set_key", "left")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("binary")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), _text_key(text).alias("text_key"))


def _text_key(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text, F.octet_length(text))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links) and kept."""
    linked = _judged(_rows(docs, id_column, text_column))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return linked.select(
        F.col("doc_id").alias(id_column),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes as pairs of their components."""
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("component").alias("_component"))
        pairs = pairs.join(named, side, "left").withColumn(side, F.coalesce("_component", side)).drop("_component")
    return pairs.where("a <> b").distinct()


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near copies, that with the smallest id, and all rows that are linked with nothing; all columns stay.

    Rows are told apart by id and text, so a text that shares its id with a copy stays. Of repeated rows in a group one stays, of one id's
    near copies the one with the smallest key. Rows of groups of one are not shuffled.
    """
    judged = _judged(_rows(docs, id_column, text_column)).where("component IS NOT NULL AND doc_id IS NOT NULL")
    keys = saved(judged.groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "keys")
    kept = keys.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("component", "k.*")
    gone = keys.join(kept, ["component", "doc_id", "text_key"], "left_anti").select("doc_id", "text_key")
    several = keys.where("n > 1").join(kept, ["component", "doc_id", "text_key"], "left_semi").select("doc_id", "text_key")
    touched = saved(gone.withColumn("stays", F.lit(False)).unionByName(several.withColumn("stays", F.lit(True))), "touched")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    body = F.col(f"row.`{text_column}`").cast("binary")
    numbered = packed.select("row", F.col(f"row.`{id_column}`").cast("long").alias("doc_id"), _text_key(body).alias("text_key"))
    pair = F.xxhash64("doc_id", "text_key").alias("pair")
    marked = hinted(numbered.withColumn("pair", pair), "pair", touched.select(pair))
    looked_up = marked.where("_maybe").join(touched, ["doc_id", "text_key"], "left")
    one = looked_up.where("stays").groupBy("doc_id", "text_key").agg(F.any_value("row").alias("row"))
    parts = (marked.where("NOT _maybe"), looked_up.where("stays IS NULL"), one)
    return reduce(DataFrame.unionAll, [p.select("row") for p in parts]).select("row.*")
