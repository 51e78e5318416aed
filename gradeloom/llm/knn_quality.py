"""Document quality by nearest-neighbour voting in a latent semantic space.

A text is a bag of hashed terms: its lower-cased words, their shapes (runs of upper case, lower case, digits,
other signs), and marks for words equal to the one before, repeated lines, and one mark per text. Document
frequencies are counted over all documents. A bounded sample of labelled documents (``SAMPLE`` rows, drawn by a hash of
their ids) spans the latent space and stays as the set of neighbours; it is broadcast. Every document gets its cosine
products with all of them, in blocks, and its ``NEIGHBOURS`` nearest vote with weights by similarity.

Defined results: null and empty texts are alike and have only the text mark; without labelled
rows the score is one half; repeated rows get the same score; labels of documents that are not there are
ignored, and of several labels of one id the smallest counts; rows with a null id are scored, never learned from and not
held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import saved
from gradeloom.llm.latent import right_vectors
from gradeloom.llm.tokens import blocks

SLOTS = 4096
SAMPLE = 3000
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK_BYTES = 2_000_000
_KNOWN_WORDS = 300_000
_MARKS = 3  # slots kept for marks: text, repeated word, repeated line
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def _slot(term: bytes) -> int:
    return _MARKS + xxhash.xxh32_intdigest(term) % (SLOTS - _MARKS)


def shape(word: bytes) -> bytes:
    """Character classes of a word, runs of one class cut to one."""
    classes = word.translate(_SHAPE)
    return bytes(c for k, c in enumerate(classes) if not k or classes[k - 1] != c)


class _Terms:
    """Slots of whole texts; words seen are remembered while a task runs, up to a number."""

    def __init__(self):
        self.known: dict[bytes, int] = {}  # both slots of a word in one number
        self.shapes: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots of a text and how often each occurs."""
        words = (text or b"").split()
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
            self.shapes.clear()
        for word in set(words).difference(self.known):
            classes = word.translate(_SHAPE)
            form = self.shapes.get(classes)
            if form is None:
                form = self.shapes[classes] = _slot(b"s" + shape(word))
            self.known[word] = _slot(b"w" + word.lower()) * SLOTS + form
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = np.bincount(codes // SLOTS, minlength=SLOTS) + np.bincount(codes % SLOTS, minlength=SLOTS)
        counts[0] = 1
        counts[1] = sum(map(eq, words, words[1:]))
        lines = [line for line in (text or b"").split(b"\n") if line.strip()]
        counts[2] = len(lines) - len(set(lines))
        slots = np.flatnonzero(counts)
        return slots, counts[slots]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, counts, documents = _Terms(), np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            counts[terms(text.as_py())[0]] += 1
            documents += 1
    if documents:
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([-1, *used], pa.int32()), "n": pa.array([documents, *counts[used]], pa.int64())})


def weighted(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of one text, of length one; term shares enter by their roots."""
    row = np.sqrt(counts / counts[1 if len(counts) > 1 else 0 :].sum()) * idf[slots]
    return (row / max(1e-12, np.linalg.norm(row))).astype(np.float32)


def _rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = _Terms(), sent.value
        for block in blocks(batches, "text", BLOCK_BYTES):
            found = [terms(t) for t in block.column("text").to_pylist()]
            slots = pa.array([s.tolist() for s, _ in found], pa.list_(pa.int32()))
            weights = pa.array([weighted(s, c, idf).tolist() for s, c in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"label": block.column("label"), "slots": slots, "weights": weights})

    return run


def vote(similarity: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Weighted share of label 1 among the most similar rows; the sample's share where nothing is similar."""
    k = min(neighbours, similarity.shape[1])
    nearest = np.argpartition(-similarity, k - 1, axis=1)[:, :k]
    weights = np.clip(np.take_along_axis(similarity, nearest, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
    total = weights.sum(axis=1)
    return np.where(total > 0, (weights * labels[nearest]).sum(axis=1) / np.maximum(total, 1e-12), labels.mean())


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, space, vectors, labels = sent.value
        terms = _Terms()
        for block in blocks(batches, "text", BLOCK_BYTES):
            latent = np.empty((block.num_rows, space.shape[1]), np.float32)
            for k, text in enumerate(block.column("text").to_pylist()):
                slots, counts = terms(text)
                latent[k] = weighted(slots, counts, idf) @ space[slots]
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
            scores = np.concatenate([vote(latent[a : a + 500] @ vectors.T, labels) for a in range(0, len(latent), 500)])
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), "score": pa.array(scores.clip(0, 1), pa.float64())})

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text), learned from ``labels`` (doc_id, label of 0 or 1)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    drawn = (
        known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), "doc_id")
        .limit(sample)
    )
    counted = rows.select("text").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    found = {r["slot"]: r["n"] for r in counted}  # at most SLOTS rows
    frequency = np.array([found.get(k, 0) for k in range(SLOTS)], float)
    idf = np.log1p((found.get(-1, 0) + 1) / (frequency + 1))
    picked = rows.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).select("label", "text")
    learned = saved(picked.mapInArrow(_rows(spark.sparkContext.broadcast(idf)), "label int, slots array<int>, weights array<double>"), "labelled")
    given = learned.limit(sample).collect()
    if not given:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    space = right_vectors(learned, SLOTS, min(rank, len(given)))
    vectors = np.stack([np.array(r["weights"], np.float32) @ space[r["slots"]] for r in given])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    model = spark.sparkContext.broadcast((idf, space, vectors, np.array([r["label"] for r in given], float)))
    return rows.mapInArrow(_score(model), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def held_out():
    """Rows that are never learned from: a fifth, by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; ``labels`` has doc_id and quality."""
    usable = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs.select("doc_id", "text"), usable)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
