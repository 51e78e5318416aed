"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import spelling


def tally(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n > 1}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows):
    n = tally(rows)
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(around[w]), n.get(form.get(w)))
    return out


def invented(seed, words=60, docs=150):
    rng = random.Random(seed)
    letters = "abeinorstéÀ÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(words)]
    rows = []
    for i in range(docs):
        out = []
        for _ in range(60):
            w = rng.choice(base[: 1 + int(words * rng.random() ** 3)])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "9"]).join(out)))
    return rows


ODD = [
    (None, "nothing nothing Nothing"), (1, None), (2, ""), (3, "short words only"), (4, "écriture Écriture écriture écritures écritures"), (4, "écriture Écriture écriture écritures écritures"),
    (5, ("x" * 5000 + " ") * 3 + ("x" * 4999 + "y ") * 40 + ("x" * 5001 + " ") * 2), (6, "aaaaaaa aaaaaaa aaaaaab aaaaaab aaaaaac aaaaaac abaaaaa abaaaaa"), (7, "straße_straßen " * 30),
]


@pytest.mark.parametrize("rows", [ODD, [], invented(1), invented(2, 200)])
@pytest.mark.parametrize("cell", [spelling.CELL, 3])
def test_variants(spark, rows, cell, monkeypatch):
    monkeypatch.setattr(spelling.neighbours, "__defaults__", (cell,))  # three words a cell: whole vectors, searched in blocks
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n long")
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = {r.word: tuple(r)[1:] for r in got.collect()}
    assert found == brute(rows)


def test_chains_end_at_the_last_form(spark):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    rows = [(k, " ".join([w] * 2 * 11**at)) for at, w in enumerate(chain[:4]) for k in (at,)]
    found = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {w: (v[0], v[1]) for w, v in brute(rows).items()}
    assert {root for _, root in found.values()} == {max(tally(rows), key=tally(rows).get)}


def test_work_does_not_grow_with_the_square_of_a_cell(spark):
    """Rows per word are bounded by the depth, whatever the number of words."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(4000)}
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    groups = spelling.letter_groups(table)
    counted = table.select("word", "n", spelling._counts(F.col("word"), groups).alias("counts"))
    depth, largest = spelling._depth(counted, len(groups), 200)
    assert largest <= 200 and 0 < depth < len(groups)
    assert spelling._visits(counted, depth).count() <= len(words) * (2 + 2 * depth + depth * (depth - 1) // 2)
