"""Randomised singular value decomposition of sparse rows that Spark holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_PARTS = 16


def _products(basis, width: int):
    """Map task: the sum of a^T (a Q) over its rows, cut into row blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = basis.value
        total = np.zeros((width, q.shape[1]), np.float32)
        some = False
        for batch in batches:
            for slots, weights in zip(batch.column("slots").to_pylist(), batch.column("weights").to_pylist()):
                if slots:
                    some = True
                    w = np.array(weights, np.float32)
                    total[slots] += w[:, None] * (w @ q[slots])
        if some:
            pieces = np.array_split(total, _PARTS)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(_PARTS), pa.int32()), "sums": pa.array([p.tobytes() for p in pieces], pa.binary())})

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(s, np.float32) for s in table.column("sums").to_pylist()], axis=0, dtype=np.float32)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def right_vectors(rows: DataFrame, width: int, rank: int, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors (width x rank) of rows of distinct ``slots`` and their ``weights``.

    Each round multiplies a basis by the Gram matrix, summed over the partitions; what comes to
    the driver has the size of the basis, whatever the number of rows.
    """
    spark = rows.sparkSession
    size = min(width, rank + 8)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0].astype(np.float32)
    image = basis
    for _ in range(rounds + 1):
        sent = spark.sparkContext.broadcast(basis)
        sums = rows.mapInArrow(_products(sent, width), "part int, sums binary")
        parts = sums.groupBy("part").applyInArrow(_added, "part int, sums binary").orderBy("part").collect()
        if not parts:
            return basis[:, :rank]
        image = np.concatenate([np.frombuffer(p["sums"], np.float32) for p in parts]).reshape(width, size)
        last, basis = basis, np.linalg.qr(image)[0].astype(np.float32)
    # Within the last basis the Gram matrix is small: its eigenvectors order the directions.
    gram = last.T @ image
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = np.argsort(-values)[:rank]
    return np.ascontiguousarray((last @ vectors[:, keep]).astype(np.float32))
