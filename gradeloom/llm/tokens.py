"""Word hashes of whole texts, inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs without ASCII white space (0x20, 0x09 to 0x0D)."""
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(base, -1, 1 << 64)


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` consecutive items, by prefix sums modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=prefix[1:])
    return (prefix[width:] - prefix[:-width]) * powers(inverse(base), n)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most_bytes`` of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array([0 if v is None else v for v in pc.binary_length(column).to_pylist()])
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
