"""Remove passages that an earlier document already has, by Rabin-Karp hashes of every token window.

Every window of ``width`` consecutive words is hashed and counted over the whole corpus; where a window
also starts in a document with a smaller id, its words go. Overlapping windows merge into maximal
intervals, as a word goes once whatever the number of windows over it.

Defined results: a null text has no words; a text shorter than a window keeps all words; rows with a
null id are kept whole and count for nobody; rows with the same id do not remove each other's words; an empty
table gives no rows; other columns are ignored. Ids are integers.

Hot windows: each task sends a window once, with the smallest id it has seen, so a passage
shared by a third of the corpus reaches its bucket once per task. Windows travel packed, about nine bytes each.
The bucket is chosen by a second hash, so two windows are confused only where 64 bits and the bucket agree.

Buckets and the groups in which documents meet their repeats grow with the bytes of all texts, so neither
fills a task at any size. A document's group is a mixed hash of its id, whatever pattern the ids have; rows that
share a frequent id are dealt over several groups by their text, each of which gets what was found for the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import partition_count
from gradeloom.llm.tokens import blocks, rolling, word_hashes, words_of

WIDTH = 50
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLOCK_BYTES = 6_000_000
#: Bytes of text that a bucket's windows and a group's documents come from, about.
BUCKET_BYTES, GROUP_BYTES = 48_000_000, 48_000_000
#: An id is frequent with more rows than this and more than this share of all rows; so there are at most 1 / share frequent ids.
FREQUENT_ROWS, FREQUENT_SHARE = 1000, 1e-4
_PACK = "bucket int, kind int, ids binary, counts binary, hashes binary"
_NAMES = ["bucket", "kind", "ids", "counts", "hashes"]


def _mixed(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of 64-bit integers."""
    prime = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
    turned = lambda x, bits: (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))
    with np.errstate(over="ignore"):
        h = np.asarray(seed, np.int64).astype(np.uint64) + prime[4] + np.uint64(8)
        h = h ^ (turned(values.astype(np.int64).astype(np.uint64) * prime[1], 31) * prime[0])
        h = turned(h, 27) * prime[0] + prime[3]
        h = (h ^ (h >> np.uint64(33))) * prime[1]
        h = (h ^ (h >> np.uint64(29))) * prime[2]
        return (h ^ (h >> np.uint64(32))).astype(np.int64)


def _dealt(ids: np.ndarray, hashes: np.ndarray, groups: int, frequent: tuple[np.ndarray, np.ndarray]) -> list[tuple]:
    """Packs of repeats for every group that may hold rows of their ids; ``frequent`` has sorted ids and their numbers of groups."""
    known, parts = frequent
    n = np.ones(len(ids), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        n = np.where(known[at] == ids, parts[at], 1)
    row = np.repeat(np.arange(len(ids)), n)
    salt = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    group = _mixed(salt, _mixed(ids[row], 42)) % groups
    return _packs(group.astype(np.int32), ids[row], hashes[row], 1)


def _packs(bucket: np.ndarray, ids: np.ndarray, hashes: np.ndarray, kind: int) -> list[tuple]:
    """Rows (bucket, kind, ids, counts, hashes) from equal-length arrays."""
    if not len(ids):
        return []
    order = np.lexsort((ids, bucket))
    bucket, ids, hashes = bucket[order], ids[order], hashes[order]
    run = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1])])
    counts = np.diff(np.r_[run, len(ids)]).astype(np.int32)
    run_bucket = bucket[run]
    cut = np.flatnonzero(np.r_[True, run_bucket[1:] != run_bucket[:-1]])
    out = []
    for a, b in zip(cut, np.r_[cut[1:], len(run)]):
        start, stop = run[a], run[b] if b < len(run) else len(ids)
        out.append((int(run_bucket[a]), kind, ids[run[a:b]].tobytes(), counts[a:b].tobytes(), hashes[start:stop].tobytes()))
    return out


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and hashes of all rows of packs."""
    columns = {c: table.column(c).to_pylist() for c in ("ids", "counts", "hashes")}
    ids = [np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)) for i, c in zip(columns["ids"], columns["counts"])]
    hashes = [np.frombuffer(h, np.uint64) for h in columns["hashes"]]
    return (np.concatenate(ids), np.concatenate(hashes)) if ids else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _repeats(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by (hash, id). Returns the order, which of the sorted rows come first for their
    hash, and which have a smaller id before them."""
    order = np.lexsort((ids, hashes))
    ids, hashes = ids[order], hashes[order]
    first = np.r_[True, hashes[1:] != hashes[:-1]] if len(ids) else np.empty(0, bool)
    smallest = ids[np.flatnonzero(first)][np.cumsum(first) - 1] if len(ids) else ids
    return order, first, ids > smallest


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)


def _windows(width: int, buckets: int, groups: int, frequent: tuple[np.ndarray, np.ndarray]):
    """Map task: windows by bucket (kind 0, once per block) and repeats found on the way (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids, firsts, seconds = [], [], []
            for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                if doc_id is None:
                    continue
                hashed = word_hashes(words_of(text))
                if len(hashed) >= width:
                    firsts.append(rolling(hashed, width, BASES[0]))
                    seconds.append(rolling(hashed, width, BASES[1]))
                    ids.append(np.full(len(firsts[-1]), doc_id, np.int64))
            if not ids:
                continue
            ids, firsts, seconds = np.concatenate(ids), np.concatenate(firsts), np.concatenate(seconds)
            bucket = ((seconds >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            order, first, again = _repeats(ids, firsts)
            ids, firsts, bucket = ids[order], firsts[order], bucket[order]
            rows = _packs(bucket[first], ids[first], firsts[first], 0)
            rows += _dealt(ids[again], firsts[again], groups, frequent)
            yield _record(rows)

    return run


def _in_bucket(groups: int, frequent: tuple[np.ndarray, np.ndarray]):
    """Reduce task: the windows of one bucket that a smaller id has too, by document group."""

    def run(table: pa.Table) -> pa.Table:
        ids, hashes = _unpack(table)
        order, _, again = _repeats(ids, hashes)
        ids, hashes = ids[order][again], hashes[order][again]
        return pa.Table.from_batches([_record(_dealt(ids, hashes, groups, frequent))])

    return run


def _covered(hashed: np.ndarray, flagged: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a flagged window."""
    starts = np.isin(rolling(hashed, width, BASES[0]), flagged)
    edge = np.zeros(len(hashed) + 1, np.int32)
    edge[: len(starts)] += starts
    edge[width : width + len(starts)] -= starts
    return np.cumsum(edge[:-1]) > 0


def _remove(width: int, with_text: bool):
    def run(docs: pa.Table, packs: pa.Table) -> pa.Table:
        ids, hashes = _unpack(packs)
        order = np.argsort(ids, kind="stable")
        ids, hashes = ids[order], hashes[order]
        out = []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
            words = words_of(text)
            total = len(words)
            a, b = (np.searchsorted(ids, doc_id, "left"), np.searchsorted(ids, doc_id, "right")) if doc_id is not None else (0, 0)
            if b > a and total >= width:
                gone = _covered(word_hashes(words), hashes[a:b], width)
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept = b" ".join(words)
            row = (doc_id, total, total - len(words), hashlib.sha256(kept).hexdigest())
            out.append(row + (kept.decode("utf-8", "replace"),) if with_text else row)
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    return run


def remove_repeats(
    docs: DataFrame,
    width: int = WIDTH,
    with_text: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    counted = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    total, bytes_, most = counted.agg(F.sum("n"), F.sum("bytes"), F.max("n")).first()
    buckets = max(2 * partition_count(docs), (bytes_ or 0) // BUCKET_BYTES)
    groups = max(2 * partition_count(docs) + 1, (bytes_ or 0) // GROUP_BYTES)
    least = max(FREQUENT_ROWS, int((total or 0) * FREQUENT_SHARE))
    often = counted.where((F.col("n") > least) & F.col("doc_id").isNotNull()).orderBy("doc_id").collect() if (most or 0) > least else []
    parts = [-(-r["n"] // least) for r in often]
    frequent = (np.array([r["doc_id"] for r in often], np.int64), np.array(parts, np.int64))
    windows = rows.mapInArrow(_windows(width, buckets, groups, frequent), _PACK)
    # Repeats known to the map tasks pass through the shuffle under keys of their own.
    keyed = windows.select((F.col("bucket") * 2 + F.col("kind")).alias("key"), "*")
    in_bucket = _in_bucket(groups, frequent)
    found = keyed.groupBy("key").applyInArrow(
        lambda table: table.select(_NAMES) if table.column("kind")[0].as_py() else in_bucket(table), _PACK
    )
    own_parts = docs.sparkSession.createDataFrame([(r["doc_id"], n) for r, n in zip(often, parts)], "_often long, _parts long")
    dealt = rows.join(F.broadcast(own_parts), F.col("doc_id") == F.col("_often"), "left")
    salt = F.pmod(F.xxhash64("text"), F.coalesce("_parts", F.lit(1).cast("long")))
    own_key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id", salt))
    grouped = dealt.select("doc_id", "text", F.pmod(own_key, F.lit(groups).cast("long")).cast("int").alias("bucket"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    kept = grouped.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_remove(width, with_text), schema)
    return kept.withColumnRenamed("doc_id", id_column)
