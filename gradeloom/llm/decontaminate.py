"""Benchmark decontamination by latent semantic retrieval, and a check of the word order.

1. The benchmark is cut into passages of at most ``PASSAGE`` words, in tasks; equal items count once. Document frequencies of
   its words are counted over all documents.
2. A distributed randomised singular value decomposition of the passages' TF-IDF rows gives a latent space for every ``SPACE_PASSAGES``
   passages, few enough for ``RANK`` directions to hold most of each. The windows of all documents are projected, but for those in which
   no passage can be a leak by the bound of 3., and those whose cosine with a passage is ``LEAST_COSINE`` or more are its candidates.
3. A net for what the cosine misses, as in windows full of other prose: passages that have enough of their rarest words around a
   window. A passage that shares ``PARAPHRASE`` of its words with a text lacks at most the rest, so enough is a bound that no leak
   can miss. It is also what a candidate of the cosine has to pass first.
4. The longest common subsequence of a candidate and the words around the window decides: ``VERBATIM`` of the
   passage is a leak; from ``PARAPHRASE`` on it is one if the item's answer is found too, there or within ``SPREAD`` times
   its length anywhere in the document. The answer is the benchmark's ``answer`` column if it has one, else the last
   sentence of the item. What stands in one place, within ``SPREAD`` times the passage's length, needs no cosine; what
   is spread wider does: a few frequent words in order, far apart, are no leak.

A benchmark of any size is taken in blocks of about ``BLOCK_PASSAGES`` passages of whole items (a longer item is a block of its own); one
block's vectors are broadcast at a time, to two scans of the documents, and released.

Defined results: null or empty texts, of documents or items, match nothing; items without words are
skipped; repeated documents match alike, repeated items once; bytes that are not UTF-8 are read as replacement characters; an
empty table gives no rows; documents with a null id are matched and reported with a null id, but not dropped; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import prefix_sums, saved
from gradeloom.llm.latent import right_vectors
from gradeloom.llm.repeats import hinted
from gradeloom.llm.tokens import blocks

PASSAGE, STRIDE = 64, 32
RANK = 128
LEAST_COSINE = 0.35
ASKED = 0.1  # share of a passage's words, its rarest, that a candidate has besides those that a leak may lack
SPREAD = 2
CELLS = 4_000_000  # counts of words, or cosines, by place and passage that a task holds at a time
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
BLOCK_PASSAGES, SPACE_PASSAGES = 4096, 512
BLOCK_BYTES = 1_500_000
_SEPARATORS = bytes(range(0x00, 0x30)) + b":;<=>?@[\\]^_`{|}~\x7f"
_PLAIN = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_MATCH = "item long, first_word long, last_word long, cosine double, overlap double, kind string, found_by string"


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.decode("utf-8", "replace").lower().encode().translate(_PLAIN).split() if text else []


def common_words(a: list, b: list) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    places: dict = {}
    for k, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << k
    ones = (1 << len(a)) - 1
    row = ones
    for word in b:
        hits = places.get(word, 0) & row
        if hits:
            row = ((row + hits) | (row - hits)) & ones
    return len(a) - row.bit_count()


#: Number of the item within its block, words, words of the answer.
Passage = tuple[int, list[bytes], list[bytes]]


@dataclass
class Index:
    passages: list[Passage]
    number: dict[bytes, int]  # of the benchmark's words
    weights: np.ndarray  # inverse document frequency of each
    spaces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per part of the passages: its words, words x rank (weighted), passages x rank (of length one)
    first: np.ndarray  # where the passages of each word begin in ``holders``
    holders: np.ndarray  # passages that have the word among their rarest, once for each time
    least: np.ndarray  # of those, how many a leak of each passage has


def _passages(item: int, text: bytes | None, answer: bytes | None) -> list[Passage]:
    words = plain_words(text)
    if not words:
        return []
    if answer is None:
        sentences = [plain_words(s) for s in (text or b"").replace(b"\n", b".").split(b".")]
        wanted = [s for s in sentences if s][-1]
    else:
        wanted = plain_words(answer)
    starts = range(0, max(1, len(words) - STRIDE), STRIDE) if len(words) > PASSAGE else [0]
    return [(item, words[s : s + PASSAGE], wanted) for s in starts]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: the passages of items, words and answer as joined words."""
    for batch in batches:
        for item, text, answer in zip(*(batch.column(c).to_pylist() for c in ("item", "text", "answer"))):
            found = _passages(item, text, answer)
            if found:
                wanted = b" ".join(found[0][2])
                yield pa.RecordBatch.from_pydict(
                    {"item": pa.array([item] * len(found), pa.int64()), "words": pa.array([b" ".join(w) for _, w, _ in found], pa.binary()), "answer": pa.array([wanted] * len(found), pa.binary())}
                )


def _frequencies(number):
    """Map task: in how many documents each word of the benchmark occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        counts = np.zeros(len(known), np.int64)
        documents = 0
        for batch in batches:
            for text in batch.column("text"):
                documents += 1
                seen = known.keys() & set(plain_words(text.as_py()))
                counts[[known[w] for w in seen]] += 1
        words = np.flatnonzero(counts)
        if documents:
            yield pa.RecordBatch.from_pydict({"word": pa.array([-1, *words], pa.int32()), "n": pa.array([documents, *counts[words]], pa.int64())})

    return run


def _row(words: list[bytes], number: dict[bytes, int], weights: np.ndarray) -> tuple[list[int], list[float]]:
    """Distinct word numbers and TF-IDF weights, of length one."""
    slots, counts = np.unique([number[w] for w in words], return_counts=True)
    row = np.sqrt(counts) * weights[slots]
    return slots.tolist(), (row / np.linalg.norm(row)).tolist()


def _least_common(n: int) -> int:
    """How many of a passage's n words a leak has at least."""
    return math.ceil(PARAPHRASE * n - 1e-9)


def _rarest(passages: list[Passage], number: dict[bytes, int], frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first``, ``holders`` and ``least`` of an index."""
    slots, owners, least = [], [], []
    for p, (_, words, _) in enumerate(passages):
        common = _least_common(len(words))
        asked = min(common, math.ceil(ASKED * len(words)))
        rare = sorted((number[w] for w in words), key=lambda k: (frequency[k], k))[: len(words) - common + asked]
        slots += rare
        owners += [p] * len(rare)
        least.append(asked)
    order = np.argsort(slots, kind="stable")
    first = np.r_[0, np.cumsum(np.bincount(slots, minlength=len(number)))]
    return first, np.array(owners)[order], np.array(least)


def _index(docs: DataFrame, passages: list[Passage], rank: int) -> Index:
    spark = docs.sparkSession
    number = {w: k for k, w in enumerate(dict.fromkeys(w for _, words, _ in passages for w in words))}
    counted = docs.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(number)), "word int, n long")
    found = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row per word of the block
    documents = found.get(-1, 0)
    frequency = np.array([found.get(k, 0) for k in range(len(number))], float)
    weights = np.log1p((documents + 1) / (frequency + 1)).astype(np.float32)  # never 0, however frequent a word is
    spaces = [_space(spark, passages[k : k + SPACE_PASSAGES], number, weights, rank) for k in range(0, len(passages), SPACE_PASSAGES)]
    return Index(passages, number, weights, spaces, *_rarest(passages, number, frequency))


def _space(spark, passages: list[Passage], number: dict[bytes, int], weights: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The latent space of some passages: their words, a weighted direction row per word, and the passages in it."""
    rows = [_row(words, number, weights) for _, words, _ in passages]
    words = np.unique(np.concatenate([s for s, _ in rows]))
    rows = [(np.searchsorted(words, s).tolist(), w) for s, w in rows]
    frame = spark.createDataFrame(rows, "slots array<int>, weights array<double>").repartition(max(1, len(rows) // 128))
    space = right_vectors(frame, len(words), min(rank, len(words), len(rows)))
    vectors = np.stack([np.array(w, np.float32) @ space[s] for s, w in rows])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return words, (space * weights[words][:, None]).astype(np.float32), (vectors / np.maximum(norms, 1e-9)).astype(np.float32)


def _compact(words: list[bytes], around: list[bytes], least: int) -> bool:
    """Whether ``least`` of the words are found, in order, within ``SPREAD`` times their length."""
    size = SPREAD * len(words)
    return any(common_words(words, around[k : k + size]) >= least for k in range(0, max(1, len(around) - len(words)), max(1, len(words) // 2)))


def _judge(words: list[bytes], answer: list[bytes], around: list[bytes], elsewhere: Callable[[], bool]) -> tuple[str | None, float]:
    """``elsewhere`` tells whether the rest of the document has the answer."""
    overlap = common_words(words, around) / len(words)
    if overlap >= VERBATIM:
        return "verbatim", overlap
    if overlap >= PARAPHRASE and answer and (common_words(answer, around) >= ANSWER * len(answer) or elsewhere()):
        return "paraphrase", overlap
    return None, overlap


class _Windows:
    """The windows of some documents: chunks of ``STRIDE`` words, of which a window has two and what is around it one more on either side."""

    def __init__(self, index: Index, known: np.ndarray, lengths: np.ndarray):
        self.index, self.known = index, known
        self.chunks = -(-lengths // STRIDE)
        self.first = np.cumsum(self.chunks) - self.chunks
        self.owner = np.repeat(np.arange(len(lengths)), self.chunks)
        place = np.arange(len(known)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.chunk = np.repeat(self.first, lengths) + place // STRIDE

    def __len__(self) -> int:
        return len(self.owner)

    def cosines(self, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per space: number of its first passage, a run of the windows, and their cosines with its passages."""
        begin = 0
        following = np.minimum(windows + 1, (self.first + self.chunks)[self.owner[windows]] - 1)
        chunks = np.unique(np.r_[windows, following])
        number = np.full(len(self), -1)
        number[chunks] = np.arange(len(chunks))
        here = np.flatnonzero((number[self.chunk] >= 0) & (self.known >= 0))
        chunk, known = number[self.chunk[here]], self.known[here]
        for words, space, vectors in self.index.spaces:
            own = np.full(len(self.index.number), -1)
            own[words] = np.arange(len(words))
            slot = own[known]
            some = slot >= 0
            starts = np.flatnonzero(np.diff(chunk[some], prepend=-1))
            sums = np.zeros((len(chunks), space.shape[1]), np.float32)
            if len(starts):
                sums[chunk[some][starts]] = np.add.reduceat(space[slot[some]], starts, axis=0)
            rows = sums[number[windows]] + np.where((following > windows)[:, None], sums[number[following]], 0)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
            step = max(16, CELLS // len(vectors))
            for at in range(0, len(windows), step):
                yield begin, windows[at : at + step], rows[at : at + step] @ vectors.T
            begin += len(vectors)

    def near_by_meaning(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, passages and cosines of all pairs of some windows from ``LEAST_COSINE`` on."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        for begin, own, cosines in self.cosines(windows) if len(windows) else ():
            w, p = np.nonzero(cosines >= LEAST_COSINE)
            found.append((own[w], p + begin, cosines[w, p]))
        return tuple(np.concatenate(part) for part in zip(*found))

    def near_by_words(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and passages of all pairs with enough rare words around the window."""
        index, n_passages, total = self.index, len(self.index.passages), len(self)
        degree = np.where(self.known >= 0, np.diff(index.first)[self.known], 0)
        hit = np.flatnonzero(degree)
        chunk, known, degree = self.chunk[hit], self.known[hit], degree[hit]
        step = max(16, CELLS // n_passages)
        for at in range(0, total, step):
            stop = min(total, at + step)
            low, high = max(0, at - 1), min(total, stop + 2)
            a, b = np.searchsorted(chunk, (low, high))
            some = degree[a:b]
            entry = np.arange(some.sum()) + np.repeat(index.first[known[a:b]] - (np.cumsum(some) - some), some)
            cells = np.bincount(np.repeat(chunk[a:b] - low, some) * n_passages + index.holders[entry], minlength=(high - low) * n_passages)
            summed = np.zeros((high - low + 1, n_passages), np.int32)
            np.cumsum(cells.reshape(-1, n_passages), axis=0, out=summed[1:])
            here = np.arange(at, stop)
            doc = self.owner[here]
            near = summed[np.minimum(here + 3, self.first[doc] + self.chunks[doc]) - low] - summed[np.maximum(here - 1, self.first[doc]) - low]
            w, p = np.nonzero(near >= index.least)
            yield here[w], p

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, place of the window's first word, passage, cosine, and whether the cosine search found the pair, in the order of the windows.

        The cosine search leaves out windows in which the rare words rule out every passage, and pairs that they rule out;
        pairs by the rare words alone are the net.
        """
        n_passages = len(self.index.passages)
        parts = [w * n_passages + p for w, p in self.near_by_words()]
        pairs = np.concatenate([np.empty(0, np.int64), *parts])
        w, p, cosine = self.near_by_meaning(np.unique(pairs // n_passages))
        meant = w * n_passages + p
        order = np.argsort(meant, kind="stable")
        meant, cosine = meant[order], cosine[order]
        at = np.searchsorted(meant, pairs)
        by_meaning = meant[np.minimum(at, max(0, len(meant) - 1))] == pairs if len(meant) else np.zeros(len(pairs), bool)
        values = np.full(len(pairs), np.nan)
        values[by_meaning] = cosine[at[by_meaning]]
        w, p = np.divmod(pairs, n_passages)
        doc = self.owner[w]
        return doc, (w - self.first[doc]) * STRIDE, p, values, by_meaning


def _cosine(index: Index, known: np.ndarray, p: int) -> float:
    """Cosine of a passage with a window that the search has not kept one for."""
    words, space, vectors = index.spaces[p // SPACE_PASSAGES]
    at = np.searchsorted(words, known)
    row = space[at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == known)]].sum(axis=0)
    return float(row @ vectors[p % SPACE_PASSAGES] / max(1e-9, np.linalg.norm(row)))


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(**sent.value)
        distinct = [frozenset(index.number[w] for w in own) for _, own, _ in index.passages]
        lacking = [len(own) - _least_common(len(own)) for _, own, _ in index.passages]
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = [plain_words(t) for t in block.column("text").to_pylist()]
            lengths = np.array([len(t) for t in texts])
            words = [w for t in texts for w in t]
            if not words:
                continue
            known = np.fromiter((index.number.get(w, -1) for w in words), np.int64, len(words))
            offsets = (np.cumsum(lengths) - lengths).tolist()
            best: dict[tuple[int, int], tuple] = {}
            answered: dict[tuple[int, int], bool] = {}

            def elsewhere(doc: int, item: int, answer: list[bytes]) -> bool:
                if (doc, item) not in answered:
                    answered[doc, item] = _compact(answer, texts[doc], math.ceil(ANSWER * len(answer) - 1e-9))
                return answered[doc, item]

            last_window = None
            for doc, start, p, cosine, by_meaning in zip(*(x.tolist() for x in _Windows(index, known, lengths).candidates())):
                begin = offsets[doc]
                first, last = max(0, start - STRIDE), min(len(texts[doc]), start + PASSAGE + STRIDE)
                if last_window != (doc, start):
                    last_window, seen = (doc, start), set(known[begin + first : begin + last].tolist())
                if len(distinct[p]) - len(distinct[p] & seen) > lacking[p]:
                    continue
                (item, own, answer), around = index.passages[p], texts[doc][first:last]
                kind, overlap = _judge(own, answer, around, lambda: elsewhere(doc, item, answer))
                key = (doc, item)
                if kind and (key not in best or best[key][4] <= overlap):
                    if not by_meaning:
                        cosine = _cosine(index, known[begin + start : begin + min(lengths[doc], start + PASSAGE)], p)
                    if key in best and (best[key][4], best[key][3]) >= (overlap, cosine):
                        continue
                    if by_meaning or _compact(own, around, math.ceil((VERBATIM if kind == "verbatim" else PARAPHRASE) * len(own) - 1e-9)):
                        best[key] = (item, first, last - 1, cosine, overlap, kind, "cosine" if by_meaning else "words")
            if best:
                names = [part.split()[0] for part in _MATCH.split(", ")]
                columns = dict(zip(names, zip(*best.values())))
                own = {c: block.column(c).take(pa.array([d for d, _ in best])) for c in ("doc_id", "text_key")}
                yield pa.RecordBatch.from_pydict({**own, **{k: list(v) for k, v in columns.items()}})

    return run


def _text_key(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text, F.octet_length(text))


def _matches(rows: DataFrame, benchmark: DataFrame, rank: int, item_column: str) -> DataFrame:
    """Matches of rows (doc_id, text, text_key) with the items, one per row and item."""
    spark = rows.sparkSession
    answer = F.col("answer").cast("binary") if "answer" in benchmark.columns else F.lit(None).cast("binary")
    items = benchmark.where(F.col("text").isNotNull()).select(F.col(item_column).alias("item_id"), F.col("text").cast("binary").alias("text"), answer.alias("answer"))
    numbered = saved(items.distinct().withColumn("item", F.monotonically_increasing_id()), "benchmark")
    passages = saved(numbered.select("item", "text", "answer").mapInArrow(_cut, "item long, words binary, answer binary"), "passages")
    sizes = passages.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    blocked = saved(
        prefix_sums(sizes, ["item"], "n").select("item", F.floor(F.col("before") / BLOCK_PASSAGES).alias("block")), "item-blocks"
    )
    kinds = dict([*rows.dtypes, *items.dtypes])
    found = []
    for block in range((blocked.agg(F.max("block")).first()[0] or 0) + 1 if not blocked.isEmpty() else 0):
        chosen = blocked.where(F.col("block") == block).select("item")
        own = passages.join(F.broadcast(chosen), "item").orderBy("item").collect()  # about BLOCK_PASSAGES rows
        answers = {r["item"]: bytes(r["answer"]).split(b" ") if r["answer"] else [] for r in own}
        sent = spark.sparkContext.broadcast(vars(_index(rows, [(r["item"], bytes(r["words"]).split(b" "), answers[r["item"]]) for r in own], rank)))
        found.append(saved(rows.mapInArrow(_search(sent), f"doc_id {kinds['doc_id']}, text_key long, {_MATCH}"), "matches"))
        sent.unpersist()
    if not found:
        return spark.createDataFrame([], f"doc_id {kinds['doc_id']}, text_key long, {_MATCH}, item_id {kinds['item_id']}")
    return reduce(DataFrame.unionAll, found).join(numbered.select("item", "item_id"), "item")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = RANK,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """One row per document and item that it contains: ids, words of the document looked at, cosine, overlap, kind, and which search found it."""
    found = _matches(_rows(docs, id_column, text_column), benchmark, rank, item_column)
    columns = ["first_word", "last_word", "cosine", "overlap", "kind", "found_by"]
    return found.select(F.col("doc_id").alias(id_column), F.col("item_id").alias(item_column), *columns)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("binary")
    return docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), _text_key(text).alias("text_key"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """The documents without those that contain benchmark items, told apart by id and text; all columns stay."""
    found = _matches(_rows(docs, id_column, text_column), benchmark, rank, item_column)
    gone = saved(found.where("doc_id IS NOT NULL").select("doc_id", "text_key").distinct(), "leaks")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = packed.select("row", F.col(f"row.`{id_column}`").alias("doc_id"), _text_key(F.col(f"row.`{text_column}`").cast("binary")).alias("text_key"))
    pair = F.xxhash64("doc_id", "text_key").alias("pair")
    marked = hinted(keyed.withColumn("pair", pair), "pair", gone.select(pair))
    stay = marked.where("_maybe").join(gone, ["doc_id", "text_key"], "left_anti").select("row")
    return marked.where("NOT _maybe").select("row").unionByName(stay).select("row.*")
