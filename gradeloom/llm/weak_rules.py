"""Quality rules as weak supervision: each rule votes, and the posterior of all votes decides.

A rule votes good, bad, or abstains where it has too little to go by. Expectation-maximisation over the
counts of vote patterns estimates how often each rule votes each way on good and on bad
documents, and how common bad documents are; a document is kept if its posterior probability
of being good reaches one half and the base rule does not fail.

Defined results: a null or blank text has no words, fails the base rule and is not kept; repeated rows
are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import saved
from gradeloom.llm.tokens import blocks, words_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BLOCK_BYTES = 4_000_000
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_letters", "n_adjacent"]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) > len(words) - 2:
        return 0  # a repeated window repeats at least its own words
    step = 1
    while step < width:  # ids of windows twice as long, from pairs of ids
        pairs = ids[: len(ids) - step] * len(words) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def _dup_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    # bytes.isspace knows the same white space as the words.
    return len(lines), len(lines) - len(set(lines))


def measures(text: bytes | None) -> tuple[int, ...]:
    """The counts that the rules look at, in the order of ``_COUNTS``."""
    if not text:
        return (0,) * len(_COUNTS)
    words = words_of(text)
    joined = b"".join(words)
    tail_bytes = len(joined.translate(None, bytes(range(0x80, 0xC0))))  # code points: bytes that do not continue one
    n_lines, n_dup = _dup_lines(text)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(joined) - len(joined.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words),
        tail_bytes,
        symbols,
        n_dup,
        repeated_words(words),
        n_lines,
        joined.count(b"!"),
        upper,
        upper + lower,
        sum(map(eq, words, words[1:])),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        rows = [measures(t) for t in block.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], names=["doc_id", *_COUNTS])


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of whole texts, one row per document."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_measure, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))


def _rule(bad: Column, good: Column, enough: Column | None = None) -> Column:
    """-1 for bad, 1 for good, 0 where the rule abstains."""
    vote = F.when(bad, -1).when(good, 1).otherwise(0)
    return (vote if enough is None else F.when(enough, vote).otherwise(0)).cast("int")


def votes() -> dict[str, Column]:
    """The rules. Most know one kind of junk and abstain where they do not see it."""
    c = F.col
    words, letters = c("n_words"), c("n_letters")
    mean = c("word_chars") / F.greatest(words, F.lit(1))
    plain = (20 * c("n_symbols") <= words) & (20 * c("n_bangs") <= words) & (4 * c("n_upper") <= letters)
    never = F.lit(False)
    return {
        "symbols": _rule(5 * c("n_symbols") > words, never, words >= 5),
        "repeated_windows": _rule(10 * c("n_repeat_words") > 3 * words, never, words >= 16),
        "repeated_lines": _rule(10 * c("n_dup_lines") > 3 * c("n_lines"), never, c("n_lines") >= 4),
        "repeated_words": _rule(4 * c("n_adjacent") > words, 20 * c("n_adjacent") <= words, words >= 8),
        "shouting": _rule(2 * c("n_upper") > letters, never, letters >= 40),
        "exclamations": _rule(10 * c("n_bangs") > 3 * words, never, words >= 5),
        "word_length": _rule((mean > 16) | (mean < 2), never, words >= 20),
        "plain": _rule(never, plain, words >= 20),
    }


def fit_reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and their counts.

    Returns the share of good documents and, per rule, class (bad, good) and vote (-1, 0, 1), its
    probability. Starts from rules that are right where they vote. A rule's bad votes stay
    likelier on bad documents, so the classes cannot change their names.
    """
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    table = np.empty((patterns.shape[1], 2, 3))
    table[:, 0], table[:, 1] = (0.3, 0.5, 0.2), (0.02, 0.5, 0.48)
    good = 0.8
    for _ in range(rounds):
        posterior = posteriors(onehot, good, table)
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        new = np.einsum("cp,prv->rcv", weight, onehot) + 0.5
        new /= new.sum(axis=2, keepdims=True)
        flipped = new[:, 0, 0] < new[:, 1, 0]
        new[flipped] = new[flipped].mean(axis=1, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        done = abs(share - good) < 1e-9 and np.abs(new - table).max() < 1e-9
        good, table = share, new
        if done:
            break
    return good, table


def posteriors(onehot: np.ndarray, good: float, table: np.ndarray) -> np.ndarray:
    """Probability of being good for each pattern."""
    odds = np.log(good / (1 - good)) + np.einsum("prv,rv->p", onehot, np.log(table[:, 1]) - np.log(table[:, 0]))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, the base counts, base_failed, kept and quality (the posterior).

    Only the counts of vote patterns come to the driver: at most 3 to the number of rules.
    """
    rules = votes()
    measured = saved(measure(docs, id_column, text_column).withColumns(rules), "measures")
    seen = measured.groupBy(*rules).count().collect()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    if seen:
        patterns = np.array([[r[name] for name in rules] for r in seen])
        _, table = fitted = fit_reliabilities(patterns, np.array([r["count"] for r in seen], float))
        gains = np.log(table[:, 1]) - np.log(table[:, 0])
        odds = F.lit(float(np.log(fitted[0] / (1 - fitted[0]))))
        for name, gain in zip(rules, gains.tolist()):
            odds = odds + F.element_at(F.array(*[F.lit(g) for g in gain]), F.col(name) + 2)
    else:
        odds = F.lit(0.0)
    quality = 1 / (1 + F.exp(-odds))
    return measured.select(
        F.col("doc_id").alias(id_column),
        *_COUNTS[:5],
        failed.alias("base_failed"),
        (~failed & (quality >= 0.5)).alias("kept"),
        quality.alias("quality"),
    )
