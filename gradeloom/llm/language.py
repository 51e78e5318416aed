"""Language of whole texts by a linear-chain conditional random field over their words.

Every word is labelled with a language from affix, character n-gram and lexicon features and
learned transitions, by forward-backward over the whole text; so code-switched passages are told apart.
A document's language is the one with the largest sum of word marginals; its score is that
sum's share of the words with letters.

The field is fitted on a bounded sample of rows, drawn by a hash of their ids: ``SAMPLE`` whole documents per language,
fewer where that would be more than ``SAMPLE_ROWS`` documents, but never under ``LEAST_SAMPLE``. Weights and transitions follow the
gradient of the likelihood, whose edge marginals come from the forward and backward messages, in batches whose memory does
not depend on the number of languages. Every ``lang`` value that occurs is learned; as the model grows with their number, more than
``MOST_LANGUAGES`` of them raise an error. Everything else covers all rows and whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0, as is everything when
there is nothing to learn from; rows with a null id are never learned from and are not held out; repeated rows get
the same label; bytes that are not UTF-8 count as one strange letter each; an empty table gives no rows; other columns are ignored or
carried in a struct, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from gradeloom.llm.tokens import blocks, powers

UNKNOWN = "und"
SLOTS = 1 << 16
SAMPLE, SAMPLE_ROWS, LEAST_SAMPLE = 150, 2000, 10
MOST_LANGUAGES = 256
EPOCHS = 6
#: Batches of an epoch at least, and numbers (words times labels) of a batch at most.
BATCHES, BATCH_NUMBERS = 8, 2_000_000
BLOCK_BYTES = 1_000_000
#: Words of a chunk with few labels and with many, for which a chunk's transfer matrix is dear.
CHUNK, LONG_CHUNK, FEW_LABELS = 32, 1024, 8
_KNOWN_WORDS = 300_000


@dataclass
class Field:
    """Labels, weights of hashed features (slots x labels) and log transitions."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Slots of numbers."""
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(SLOTS)).astype(np.int64)


def _slots(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all features of lower-cased words, the word each belongs to, and how many a word has.

    Features of the letters of a word: the word itself, its affixes up to three letters, its bigrams and
    its trigrams, both with its edges. Words without letters have none. Works on the code points of all words at once.
    """
    points = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), np.uint32)
    kinds, of = np.unique(points, return_inverse=True)
    letter = np.array([chr(p).isalpha() for p in kinds], bool)[of]
    owner = (np.cumsum(points == 10) - (points == 10))[letter]
    chars = points[letter].astype(np.uint64)
    n = np.bincount(owner, minlength=len(words))
    starts = np.cumsum(n) - n
    place = np.arange(len(chars)) - starts[owner]
    rest = n[owner] - place
    before = np.where(place > 0, np.roll(chars, 1), np.uint64(1))
    after = np.where(rest > 1, np.roll(chars, -1), np.uint64(2))
    wide = np.uint64(21)
    pairs = (before << wide) | chars
    triples = (pairs << wide) | after
    found, owners = [_mixed(pairs, 1), _mixed(triples, 2)], [owner, owner]
    for k in range(3):
        for salt, where, step in ((3, place == k, -1), (6, rest == k + 1, 1)):
            at = np.flatnonzero(where)
            key = np.zeros(len(at), np.uint64)
            for j in range(k + 1):
                key = (key << wide) | chars[at + step * j]
            found.append(_mixed(key, salt + k))
            owners.append(owner[at])
    some = np.flatnonzero(n)
    if len(some):
        whole = np.add.reduceat(chars * powers(0x9E3779B97F4A7C15, int(n.max()))[place], starts[some])
        found.append(_mixed(whole, 9))
        owners.append(some)
    owners = np.concatenate(owners)
    return np.concatenate(found), owners, np.bincount(owners, minlength=len(words))


def emissions(weights: np.ndarray, flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of a word's feature weights over the root of their number, so long words do not outweigh others."""
    sums = [np.bincount(owner, weights[flat, k], len(sizes)) for k in range(weights.shape[1])]
    return 3 * np.stack(sums, axis=1) / np.sqrt(np.maximum(sizes, 1))[:, None]


def _scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / x.max(axis=axes, keepdims=True)


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, chunk: int | None = None) -> np.ndarray:
    """Label probabilities of every word of several texts, by forward-backward."""
    forward, _, backward = messages(scores, lengths, transitions, chunk)
    found = forward * backward
    return found / found.sum(axis=1, keepdims=True)


def edge_sums(forward: np.ndarray, local: np.ndarray, backward: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected number of every transition between neighbouring words: the exact edge marginals, summed (labels squared).

    An edge has the probability forward(a) * exp(transition(a, b)) * local(b) * backward(b), made to sum to one.
    """
    inner = np.ones(len(forward), bool)
    inner[np.cumsum(lengths) - 1] = False
    left = np.flatnonzero(inner)
    step = np.exp(transitions - transitions.max())
    into = local[left + 1] * backward[left + 1]
    total = ((forward[left] @ step) * into).sum(axis=1, keepdims=True)
    return ((forward[left] / total).T @ into) * step


def messages(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, chunk: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word the forward message (with its own potential), its potential and the backward message, each up to a factor.

    ``scores`` holds the words of all texts one after the other. Texts are cut into chunks; the transfer matrices of those
    chunks whose text goes on are formed at once and chained per text, and the words within all
    chunks follow again at once. The result is exact.
    """
    n_labels = scores.shape[1]
    chunk = chunk or (CHUNK if n_labels <= FEW_LABELS else LONG_CHUNK)
    chunk = max(1, min(chunk, int(lengths.max(initial=1))))
    step = np.exp(transitions - transitions.max())
    chunks = -(-lengths // chunk)
    first = np.cumsum(chunks) - chunks
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = (first[text_of] + within // chunk, within % chunk)
    total = int(chunks.sum())
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    psi = np.ones((total, chunk, n_labels))
    psi[at] = local
    real = np.zeros((total, chunk), bool)
    real[at] = True

    into = np.ones((total, n_labels))  # forward message that enters a chunk
    out_of = np.ones((total, n_labels))  # backward message that enters it from behind
    long = np.repeat(chunks > 1, chunks)
    if long.any():
        number = np.cumsum(long) - 1
        transfer = np.broadcast_to(np.eye(n_labels), (int(long.sum()), n_labels, n_labels)).copy()
        for t in range(chunk):
            on = np.flatnonzero(real[:, t] & long)
            transfer[number[on]] = _scaled((transfer[number[on]] @ step) * psi[on, t][:, None, :], (1, 2))
        by_size = np.argsort(-chunks, kind="stable")
        active = np.searchsorted(-chunks[by_size], -np.arange(1, chunks.max()), side="left")
        for k, n in enumerate(active):  # chunk k to k + 1, for the texts that have the latter
            here = first[by_size[:n]] + k
            into[here + 1] = _scaled((into[here][:, None, :] @ transfer[number[here]])[:, 0], (1,))
        for k in range(len(active) - 1, -1, -1):
            here = first[by_size[: active[k]]] + k
            out_of[here] = _scaled((transfer[number[here + 1]] @ out_of[here + 1][:, :, None])[:, :, 0], (1,))

    forward, backward = np.empty_like(psi), np.empty_like(psi)
    message = into
    for t in range(chunk):
        message = np.where(real[:, t, None], _scaled((message @ step) * psi[:, t], (1,)), message)
        forward[:, t] = message
    message = out_of
    for t in range(chunk - 1, -1, -1):
        backward[:, t] = message
        message = np.where(real[:, t, None], _scaled((psi[:, t] * message) @ step.T, (1,)), message)
    return forward[at], local, backward[at]


def _sequences(samples: list[tuple[str, str]], seed: int = 11) -> tuple[list[str], list[int], np.ndarray, list[str]]:
    """Stitch sentences of all samples into code-switched sequences: words, labels, lengths, label names."""
    labels = sorted({lang for lang, _ in samples})
    number = {lang: k for k, lang in enumerate(labels)}
    sentences = []
    for lang, text in samples:
        part: list[str] = []
        for word in text.lower().split():
            part.append(word)
            if word.endswith((".", "!", "?")) or len(part) >= 40:
                sentences.append((number[lang], part))
                part = []
        if part:
            sentences.append((number[lang], part))
    order = np.random.default_rng(seed).permutation(len(sentences))
    words, truth, lengths = [], [], []
    for k in range(0, len(order), 4):
        size = len(words)
        for s in order[k : k + 4]:
            words += sentences[s][1]
            truth += [sentences[s][0]] * len(sentences[s][1])
        lengths.append(len(words) - size)
    return words, truth, np.array(lengths), labels


def _batches(lengths: np.ndarray, n_labels: int) -> list[tuple[int, int]]:
    """Runs of sequences with about equally many words, at least ``BATCHES``, none above ``BATCH_NUMBERS`` but for a longer sequence."""
    words = max(1, min(int(lengths.sum()) // BATCHES, BATCH_NUMBERS // n_labels))
    number = (np.cumsum(lengths) - lengths) // words
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(lengths)]))


def fit(samples: list[tuple[str, str]], epochs: int = EPOCHS) -> Field | None:
    """Train by ascent along the gradient of the likelihood of the stitched sequences, batch by batch; None without samples."""
    words, truth, lengths, labels = _sequences(samples)
    if not words:
        return None
    truth, n = np.array(truth), len(labels)
    kinds, of = np.unique(np.array(words, dtype=object), return_inverse=True)
    weights, transitions = np.zeros((SLOTS, n), np.float32), np.zeros((n, n))
    squares, pair_squares = np.full((SLOTS, n), 1e-3, np.float32), np.full((n, n), 1e-3)
    ends = np.cumsum(lengths)
    batches = _batches(lengths, n)
    for _ in range(epochs):
        for start, stop in batches:
            part = slice(ends[start] - lengths[start], ends[stop - 1])
            sizes, own = lengths[start:stop], truth[part]
            met, place = np.unique(of[part], return_inverse=True)
            flat, owner, n_features = _slots(list(kinds[met]))
            scores = emissions(weights, flat, owner, n_features)[place]
            forward, local, backward = messages(scores, sizes, transitions, int(sizes.max()))
            error = forward * backward
            error /= -error.sum(axis=1, keepdims=True)
            error[np.arange(len(own)), own] += 1
            scale = 3 / np.sqrt(np.maximum(n_features, 1))
            slots, where = np.unique(flat, return_inverse=True)
            decay = 0.5 / len(batches)
            for k in range(n):
                by_kind = np.bincount(place, error[:, k], len(met)) * scale
                slope = np.bincount(where, by_kind[owner], len(slots)) - decay * weights[slots, k]
                squares[slots, k] += slope**2
                weights[slots, k] += 0.5 * slope / np.sqrt(squares[slots, k])
            inner = np.ones(len(own), bool)
            inner[np.cumsum(sizes) - 1] = False
            left = np.flatnonzero(inner)
            seen = np.bincount(own[left] * n + own[left + 1], minlength=n * n).reshape(n, n)
            pull = seen - edge_sums(forward, local, backward, sizes, transitions) - decay * transitions
            pair_squares += pull**2
            transitions += 0.2 * pull / np.sqrt(pair_squares)
    return Field(labels, weights, transitions)


class _Scorer:
    """Emission scores of words, kept while a task runs, up to a number of words."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.empty((0, len(self.field.labels)))
        self.letters = np.empty(0, bool)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > _KNOWN_WORDS:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            for w in new:
                self.number[w] = len(self.number)
            flat, owner, sizes = _slots(new)
            self.scores = np.concatenate([self.scores, emissions(self.field.weights, flat, owner, sizes)])
            self.letters = np.concatenate([self.letters, sizes > 0])
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return self.scores[at], self.letters[at]


def _label(model, with_words: bool):
    """Map task: the column ``row`` as it is, and the labels of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(**model.value)
        scorer = _Scorer(field)
        names = np.array(field.labels, dtype=object)
        block_bytes = BLOCK_BYTES * 4 // max(4, len(names))
        for block in blocks(batches, "text", block_bytes):
            texts = [(t or b"").decode("utf-8", "replace").lower().split() for t in block.column("text").to_pylist()]
            lengths = np.array([len(t) for t in texts])
            words = [w for t in texts for w in t]
            langs, shares, runs = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), [[] for _ in texts]
            if words:
                scores, letters = scorer(words)
                full = np.flatnonzero(lengths)
                found = marginals(scores, lengths[full], field.transitions)
                starts = np.cumsum(lengths[full]) - lengths[full]
                sums = np.add.reduceat(found * letters[:, None], starts, axis=0)
                counted = np.add.reduceat(letters.astype(float), starts)
                best = sums.argmax(axis=1)
                some = counted > 0
                langs[full[some]] = names[best[some]]
                shares[full[some]] = (sums.max(axis=1)[some] / counted[some]).clip(0, 1)
                if with_words:
                    top = found.argmax(axis=1)
                    for k, a in zip(full, starts):
                        own = top[a : a + lengths[k]]
                        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                        runs[k] = [{"first": int(x), "last": int(y) - 1, "lang": names[own[x]]} for x, y in zip(cuts, np.r_[cuts[1:], len(own)])]
            columns = {"row": block.column("row"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(shares, pa.float64())}
            if with_words:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
                columns["runs"] = pa.array(runs, kind)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def sample(docs: DataFrame, per_language: int = SAMPLE, most_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES) -> list[tuple[str, str]]:
    """(lang, text) of a bounded sample of rows of (doc_id, text, lang), drawn by hash."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", "lang", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 40)).alias("drawn")
    )
    # All languages: one that is left out could never be found.
    languages = rows.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn; name fewer in the training rows or raise most_languages")
    if not languages:
        return []
    per_language = min(per_language, max(LEAST_SAMPLE, most_rows // len(languages)))
    # About twice as many as needed by the hash alone; only those are ranked.
    limit = F.element_at(F.create_map(*[F.lit(v) for r in languages for v in (r["lang"], min(1 << 40, (2 * per_language << 40) // r["count"]))]), F.col("lang"))
    few = rows.where(F.col("drawn") <= limit)
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id"))).where(F.col("_rank") <= per_language)
    chosen = F.broadcast(ranked.select("doc_id", "lang").distinct())  # at most per_language rows a language
    picked = docs.where("text IS NOT NULL").join(chosen, ["doc_id", "lang"]).select("doc_id", "lang", "text")
    limited = picked.orderBy("doc_id", "lang", F.xxhash64("text")).limit(len(languages) * per_language)
    return [(r["lang"], r["text"]) for r in limited.collect() if r["text"]]


_RUNS = "array<struct<first: bigint, last: bigint, lang: string>>"


def label(docs: DataFrame, training: DataFrame, with_words: bool = False, text_column: str = "text") -> DataFrame:
    """Every document as the struct ``row``, with ``lang_pred``, ``score`` and, if asked for, ``runs`` of words (first, last, lang).

    ``training`` has columns doc_id, text, lang and holds the rows that may be learned from.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return _labelled(docs.select(row, F.col(text_column).cast("binary").alias("text")), training, with_words)


def _labelled(packed: DataFrame, training: DataFrame, with_words: bool) -> DataFrame:
    field = fit(sample(training))
    if field is None:
        none = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)} | ({"runs": F.expr(f"CAST(array() AS {_RUNS})")} if with_words else {})
        return packed.drop("text").withColumns(none)
    added = "lang_pred string, score double" + f", runs {_RUNS}" * with_words
    schema = StructType([packed.schema["row"], *StructType.fromDDL(added).fields])
    model = packed.sparkSession.sparkContext.broadcast(vars(field))
    return packed.mapInArrow(_label(model, with_words), schema)


def identify(
    docs: DataFrame,
    training: DataFrame,
    with_words: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: id, lang_pred, score and, if asked for, ``runs`` of words."""
    packed = docs.select(F.struct(F.col(id_column).alias("id")).alias("row"), F.col(text_column).cast("binary").alias("text"))
    found = _labelled(packed, training, with_words)
    return found.select(F.col("row.id").alias(id_column), "lang_pred", "score", *["runs"] * with_words)


def held_out(id_column: str = "doc_id"):
    """Rows that are never learned from: a quarter, by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of documents, learned from their own rows that are not held out."""
    training = docs.where(~held_out()).select("doc_id", "text", "lang")
    return identify(docs, training).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
