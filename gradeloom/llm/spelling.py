"""Spelling variants: words that differ by one letter, found by a trie over letter-group counts.

The letters are dealt into ``GROUPS`` groups of nearly equal weight, and a word is arranged by its length and by how many
letters of each group it has, one group after the other. One inserted letter is a surplus of one in one group; one
replaced letter a surplus of one and a deficit of one, or neither within a group. So the partners of a word are
found by a depth-first search that spends a budget of one surplus and one deficit, and the words at the leaves are verified.

The top of the trie is a key in Spark: stored words go to the cell of their length and first counts, and every word visits the
cells it can reach within its budget. How many counts make the key follows from the words: as few as keep cells
below ``CELL`` words; a cell that is still larger is searched in blocks. The rest of the trie is searched in tasks. Each
pair is looked for from one side only: the partner is longer or has the surplus in an earlier group than the deficit. No pairs leave a
task, only a word's number of partners in a cell and the most frequent of them.

Defined results: a null text has no words; a null doc_id is written as nothing before the colon; repeated rows count one by one;
words of any length are handled; ties between forms go to the smaller word in code-point order; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import partition_count, saved

RUN = "[A-Za-z\\u00C0-\\u00FF]{7,}"
SHORTEST = 7
RARE_DRAW = 31
TIMES = 10
GROUPS = 12
CELL = 4096
#: Visits in one group of rows, about; and how many (query, stored) pairs are compared at once.
BUCKET_ROWS = 50_000
PAIRS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a row is to its cell: a stored word, or a visitor with what it may still spend.
STORED, BOTH, DEFICIT, NOTHING, SURPLUS = range(5)


def _lowered(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of the words with at least two occurrences.

    A run of under seven letters cannot give a word, so it is not looked at. One run in 31, drawn by the checksum of id and run, loses a letter.
    """
    runs = docs.select(F.col(id_column).alias("doc_id"), F.explode(F.regexp_extract_all(text_column, F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc_id", _lowered(F.col("run")).alias("run"))
    drawn = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("drawn") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = low.withColumn("drawn", drawn).select(F.when(F.col("drawn") % RARE_DRAW == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of all words in groups of nearly equal weight; the pattern admits 90 letters."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    out, weight = [""] * groups, [0] * groups
    for row in sorted(letters, key=lambda r: (-r["count"], r["letter"])):
        least = weight.index(min(weight))
        out[least] += row["letter"]
        weight[least] += row["count"]
    return out


def _counts(word: Column, groups: list[str]) -> Column:
    """Number of letters of each group."""
    return F.array(*[F.length(word) - F.length(F.translate(word, letters, "")) if letters else F.lit(0) for letters in groups])


def _cell(length: Column, counts: Column) -> Column:
    return F.concat_ws(".", length.cast("string"), F.array_join(F.transform(counts, lambda x: x.cast("string")), "."))


def _cell_sizes(counted: DataFrame, depth: int) -> DataFrame:
    return counted.groupBy(_cell(F.length("word"), F.slice("counts", 1, depth)).alias("cell")).agg(F.count(F.lit(1)).alias("size"))


def _depth(counted: DataFrame, groups: int, most: int) -> tuple[int, int]:
    """Least number of counts in the key that keeps cells within ``most`` words, and the largest cell's size at that depth."""
    depths = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups))).alias("depth"))
    sizes = depths.groupBy("depth", _cell(F.length("word"), F.slice("counts", F.lit(1), F.col("depth"))).alias("cell")).agg(F.count(F.lit(1)).alias("size"))
    largest = {r["depth"]: r["largest"] for r in sizes.groupBy("depth").agg(F.max("size").alias("largest")).collect()}
    depth = next((d for d in range(groups + 1) if largest.get(d, 0) <= most), groups)
    return depth, largest.get(depth, 0)


def _visits(counted: DataFrame, depth: int) -> DataFrame:
    """(cell, role, word, n) of the cells that every word can reach within its budget."""
    moves = [(0, -1, -1, BOTH), (1, -1, -1, SURPLUS)]
    moves += [(grow, up, -1, NOTHING if grow else DEFICIT) for grow in (0, 1) for up in range(depth)]
    moves += [(0, up, down, NOTHING) for up in range(depth) for down in range(up + 1, depth)]
    options = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("grow", "up", "down", "role"), move)]) for move in moves])
    moved = counted.select("word", "n", F.slice("counts", 1, depth).alias("key"), F.explode(options).alias("m"))
    possible = moved.where((F.col("m.down") < 0) | (F.get("key", F.col("m.down")) > 0))
    shifted = F.transform("key", lambda x, k: x + F.when(k == F.col("m.up"), 1).when(k == F.col("m.down"), -1).otherwise(0))
    return possible.select(_cell(F.length("word") + F.col("m.grow"), shifted).alias("cell"), F.col("m.role").alias("role"), "word", "n")


class _Bucket:
    """The cells of one group of rows: words with their letters and counts, and the search."""

    def __init__(self, table: pa.Table, groups: list[str], depth: int):
        self.words = table.column("word").to_pylist()
        self.n = table.column("n").to_numpy()
        self.role = table.column("role").to_numpy()
        self.depth = depth
        self.letters = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(w) for w in self.words])
        self.start = np.cumsum(self.length) - self.length
        group = np.zeros(256, np.int64)
        for g, letters in enumerate(groups):
            group[[ord(x) for x in letters]] = g
        owner = np.repeat(np.arange(len(self.words)), self.length)
        width = len(groups)
        self.counts = np.bincount(owner * width + group[self.letters], minlength=len(self.words) * width).reshape(-1, width)
        _, self.cell = np.unique(np.array(table.column("cell").to_pylist(), dtype=object), return_inverse=True)
        stored = np.flatnonzero(self.role == STORED)
        keys = [self.counts[stored, level] for level in range(width - 1, depth - 1, -1)]
        self.stored = stored[np.lexsort([*keys, self.cell[stored]])]
        visitors = np.flatnonzero(self.role != STORED)
        self.visitors = visitors[np.argsort(self.cell[visitors], kind="stable")]
        kinds = {w: k for k, w in enumerate(sorted(set(self.words)))}
        self.alphabetical = np.array([kinds[w] for w in self.words])
        order = np.lexsort((self.alphabetical, -self.n))
        self.preferred = np.empty(len(order), np.int64)  # a smaller number is more frequent, then earlier
        self.preferred[order] = np.arange(len(order))
        self.by_preference = order
        self.near = np.zeros(len(order), np.int64)
        self.best = np.full(len(order), len(order), np.int64)

    def search(self) -> None:
        held, waiting = [], 0
        cells = self.cell[self.stored]
        for cell in np.unique(self.cell[self.visitors]):
            lo, hi = np.searchsorted(cells, (cell, cell + 1))
            a, b = np.searchsorted(self.cell[self.visitors], (cell, cell + 1))
            visitors = self.visitors[a:b]
            role = self.role[visitors]
            surplus = (role == BOTH) | (role == SURPLUS)
            deficit = (role == BOTH) | (role == DEFICIT)
            for pair in self._descend(lo, hi, self.depth, visitors, surplus, deficit) if hi > lo else ():
                held.append(pair)
                waiting += len(pair[0])
                if waiting >= PAIRS:
                    self._verify(held)
                    held, waiting = [], 0
        self._verify(held)

    def _descend(self, lo, hi, level, visitors, surplus, deficit):
        """Depth-first: candidate (visitors, stored) below the node that holds the stored words lo to hi."""
        if level == self.counts.shape[1] or len(visitors) * (hi - lo) <= 64:
            step = max(1, PAIRS // (hi - lo))
            for k in range(0, len(visitors), step):
                some = visitors[k : k + step]
                yield np.repeat(some, hi - lo), np.tile(self.stored[lo:hi], len(some))
            return
        column = self.counts[self.stored[lo:hi], level]
        borders = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
        own = self.counts[visitors, level]
        for start, stop in zip(borders, np.r_[borders[1:], hi - lo]):
            more = column[start] - own
            # The surplus comes first, so that a pair is found from one side.
            fits = (more == 0) | ((more == 1) & surplus) | ((more == -1) & deficit & ~surplus)
            if fits.any():
                yield from self._descend(lo + start, lo + stop, level + 1, visitors[fits], (surplus & (more != 1))[fits], (deficit & (more != -1))[fits])

    def _verify(self, held: list) -> None:
        """Keep the pairs that really differ by one letter and are looked at from the right side, and note both partners."""
        if not held:
            return
        q, s = (np.concatenate(side) for side in zip(*held))
        more = self.counts[s] - self.counts[q]
        first = np.take_along_axis(more, (more != 0).argmax(axis=1)[:, None], axis=1)[:, 0]
        right = (np.abs(more).sum(axis=1) <= 2) & ((first == 1) | ((first == 0) & (self.alphabetical[s] > self.alphabetical[q])))
        q, s = q[right], s[right]
        order = np.lexsort((self.length[q], self.length[s]))
        q, s = q[order], s[order]
        sizes = self.length[s] * 2 + (self.length[s] - self.length[q])
        for block in np.split(np.arange(len(q)), np.flatnonzero(np.diff(sizes)) + 1):
            if not len(block):
                continue
            step = max(1, 4_000_000 // int(self.length[s[block[0]]]))
            for k in range(0, len(block), step):
                self._note(q[block[k : k + step]], s[block[k : k + step]])

    def _note(self, q: np.ndarray, s: np.ndarray) -> None:
        long, short = self.length[s[0]], self.length[q[0]]
        a = self.letters[self.start[q][:, None] + np.arange(short)]
        b = self.letters[self.start[s][:, None] + np.arange(long)]
        ahead = np.c_[a != b[:, :short], np.ones(len(q), bool)].argmax(axis=1)
        behind = np.c_[a[:, ::-1] != b[:, ::-1][:, :short], np.ones(len(q), bool)].argmax(axis=1)
        near = (ahead + behind >= long - 1) & (self.alphabetical[q] != self.alphabetical[s])
        q, s = q[near], s[near]
        for one, other in ((q, s), (s, q)):
            self.near += np.bincount(one, minlength=len(self.near))
            np.minimum.at(self.best, one, self.preferred[other])

    def found(self) -> pa.Table:
        some = np.flatnonzero(self.near)
        best = self.by_preference[self.best[some]]
        return pa.table(
            {
                "word": pa.array([self.words[k] for k in some], pa.string()),
                "near": pa.array(self.near[some], pa.int64()),
                "best": pa.array([self.words[k] for k in best], pa.string()),
                "best_n": pa.array(self.n[best], pa.int64()),
            }
        )


def _searcher(groups: list[str], depth: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = _Bucket(table, groups, depth)
        bucket.search()
        return bucket.found()

    return run


def neighbours(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, near, best, best_n): parts of every word's number of near words, with the most frequent of each part."""
    groups = letter_groups(words)
    counted = words.select("word", "n", _counts(F.col("word"), groups).alias("counts"))
    depth, largest = _depth(counted, len(groups), cell)
    stored = counted.select(_cell(F.length("word"), F.slice("counts", 1, depth)).alias("cell"), F.lit(STORED).alias("role"), "word", "n")
    visits = _visits(counted, depth)
    if largest > cell:  # even whole vectors are shared by many words: their cells are searched in blocks of stored words
        parts = _cell_sizes(counted, depth).where(F.col("size") > cell).select("cell", F.ceil(F.col("size") / cell).cast("int").alias("parts"))
        last = F.coalesce("parts", F.lit(1)) - 1
        block = F.pmod(F.xxhash64("word"), last + 1).cast("int")
        stored = stored.join(parts, "cell", "left").select(F.concat_ws("/", "cell", block.cast("string")).alias("cell"), "role", "word", "n")
        visits = visits.join(parts, "cell", "left").withColumn("block", F.explode(F.sequence(F.lit(0), last)))
        visits = visits.select(F.concat_ws("/", "cell", F.col("block").cast("string")).alias("cell"), "role", "word", "n")
    rows = saved(stored.unionByName(visits), "visits")
    buckets = max(partition_count(words), rows.count() // BUCKET_ROWS)
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInArrow(_searcher(groups, depth), "word string, near long, best string, best_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following forms; every round doubles the steps, and counts grow tenfold a step, so rounds are few."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while not now.join(now.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = saved(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = saved(count_words(docs, id_column, text_column), "words")
    parts = neighbours(words).select(
        "word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")).alias("best")
    )
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less: bigint, word: string>").alias("best"))
    merged = own.unionByName(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    frequent = -F.col("best.less") >= TIMES * F.col("n")
    found = saved(
        merged.select("word", "n", "n_near", F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")), "forms"
    )
    rooted = found.join(_roots(found.where("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
