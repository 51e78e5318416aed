import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate, latent


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for k, y in enumerate(b):
            row[k + 1] = last[k] + 1 if x == y else max(last[k + 1], row[k])
    return row[-1]


def test_common_words_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 80))] for _ in range(2))
        assert decontaminate.common_words(a, b) == lcs(a, b)


def test_right_vectors(spark):
    rng = np.random.default_rng(0)
    dense = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 50))
    rows = [(list(range(50)), row.tolist()) for row in dense]
    frame = spark.createDataFrame(rows, "slots array<int>, weights array<double>").repartition(4)
    found = latent.right_vectors(frame, 50, 6)
    exact = np.linalg.svd(dense)[2][:6].T
    assert np.allclose(np.abs(exact.T @ found).diagonal(), 1, atol=1e-2)
    assert np.allclose(found.T @ found, np.eye(6), atol=1e-3)


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(9)
    common = [f"c{k}" for k in range(30)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(4000)}"
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(k, "\n".join(sentence(rng.randrange(6, 16)) for _ in range(3))) for k in range(60)] + [(100, None), (101, ""), (102, sentence(200)), (5, "again the same number, other words entirely w1 w2 w3")]
    prose = lambda n: " ".join(sentence(12) for _ in range(n))
    docs, want = [], set()
    for k in range(300):
        docs.append((k, prose(rng.randrange(1, 40))))
    for k in range(60):
        words = items[k][1].split()
        verbatim = " ".join(words)
        docs.append((1000 + k, f"{prose(rng.randrange(9))} {verbatim.upper() if k % 5 == 0 else verbatim} {prose(rng.randrange(9))}"))
        want.add((1000 + k, k))
        edited = [w for j, w in enumerate(words) if j % 6 != 2 or j > len(words) - 8]
        docs.append((2000 + k, f"{prose(5)} {' '.join(edited)} {prose(5)}"))
        want.add((2000 + k, k))
    docs += [(3000, None), (3001, ""), (3002, "... !"), (3003, prose(3000) + " " + items[7][1]), (None, items[8][1]), (3004, items[62][1])]
    want |= {(3003, 7), (None, 8), (3004, 102)}
    return docs, items, want


def test_planted_leaks(spark, leaks):
    docs, items, want = leaks
    frame = spark.createDataFrame([(t, i, "x", 1.0) for i, t in docs], "text string, doc_id long, item string, cosine double").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench).collect()}
    assert got == want
    kept = decontaminate.drop_leaks(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want} | {None}


def test_blocks_and_answers(spark, leaks, monkeypatch):
    docs, items, want = leaks
    monkeypatch.setattr(decontaminate, "BLOCK_PASSAGES", 20)
    monkeypatch.setattr(decontaminate, "SPACE_PASSAGES", 8)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    answered = spark.createDataFrame([(i, t, "not in any document" if i % 2 else None) for i, t in items], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.find_leaks(frame, answered).collect()}
    assert set(got) <= want and {k for k in want if k[0] != 3004 and (k[0] or 0) < 2000} <= set(got)


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, bench).collect() == []
    assert decontaminate.find_leaks(bench.withColumnRenamed("item_id", "doc_id"), bench.limit(0)).collect() == []


def planted(seed, n_items, n_docs, lengths=(15, 60)):
    """Items of frequent and rare words, and documents with one whole item each amid other prose."""
    rng = random.Random(seed)
    word = lambda: f"w{int(3000 * rng.random() ** 3)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(*lengths)))) for k in range(n_items)]
    prose = lambda n: " ".join(word() if rng.random() < 0.6 else f"x{rng.randrange(20000)}" for _ in range(n))
    docs = [(d, f"{prose(rng.randrange(20, 120))} {items[d * n_items // n_docs][1]} {prose(rng.randrange(20, 120))}") for d in range(n_docs)]
    return docs, items, {(d, d * n_items // n_docs) for d in range(n_docs)}


@pytest.mark.parametrize("n_items", [1000, 4000])
def test_whole_items_are_found_whatever_the_size_of_the_benchmark(spark, n_items):
    docs, items, want = planted(n_items, n_items, 250)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = decontaminate.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    by_cosine = {(r.doc_id, r.item_id) for r in found if r.found_by == "cosine"} & want
    print("missed", len(want - got), "of", len(want), "more", len(got - want), "by cosine", len(by_cosine))
    assert want <= got and len(got - want) <= 2 and len(by_cosine) >= 0.9 * len(want)


def test_the_cosine_decides_what_it_searches(monkeypatch):
    """Windows with the words of a passage are found by their cosine; with the bound out of reach only the net finds them."""
    rng = np.random.default_rng(2)
    word = lambda: b"w%d" % rng.integers(400)
    passages = [(k, [word() for _ in range(40)], []) for k in range(30)]
    number = {w: k for k, w in enumerate(dict.fromkeys(w for _, words, _ in passages for w in words))}
    frequency, weights = np.ones(len(number)), np.ones(len(number), np.float32)
    rows = [decontaminate._row(words, number, weights) for _, words, _ in passages]
    dense = np.zeros((30, len(number)))
    for at, (slots, values) in enumerate(rows):
        dense[at, slots] = values
    space = np.linalg.svd(dense, full_matrices=False)[2].T.astype(np.float32)
    vectors = dense @ space
    spaces = [(np.arange(len(number)), space, (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32))]
    index = decontaminate.Index(passages, number, weights, spaces, *decontaminate._rarest(passages, number, frequency))
    texts = [[b"x"] * 64 + passages[k][1] + [b"x"] * 24 for k in range(30)]
    known = np.array([number.get(w, -1) for t in texts for w in t])
    windows = decontaminate._Windows(index, known, np.array([len(t) for t in texts]))
    doc, start, passage, cosine, by_meaning = windows.candidates()
    assert {(d, p) for d, p, m in zip(doc, passage, by_meaning) if m} >= {(k, k) for k in range(30)}
    assert np.nanmin(cosine) >= decontaminate.LEAST_COSINE and np.isnan(cosine[~by_meaning]).all()
    for d, a, p, c in zip(doc[by_meaning], start[by_meaning], passage[by_meaning], cosine[by_meaning]):
        own = known[int(d) * 128 + a : int(d) * 128 + min(128, a + decontaminate.PASSAGE)]
        assert abs(decontaminate._cosine(index, own, p) - c) < 1e-4
    monkeypatch.setattr(decontaminate, "LEAST_COSINE", 2)
    again = windows.candidates()
    assert not again[4].any() and len(again[0]) == len(doc)


def test_rows_are_told_apart_and_bytes_are_read(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs = spark.createDataFrame([(1, item + " end"), (1, "clean words of the same id"), (2, item), (3, "other"), (3, "other")], "doc_id long, text string")
    broken = docs.withColumn("text", F.when(F.col("doc_id") == 2, F.concat(F.col("text").cast("binary"), F.lit(b" \xff"))).otherwise(F.col("text").cast("binary")))
    bench = spark.createDataFrame([(1, item)] * 5 + [(2, item)], "item_id long, text string")
    kept = decontaminate.drop_leaks(broken, bench).collect()
    assert sorted((r.doc_id, bytes(r.text)) for r in kept) == [(1, b"clean words of the same id"), (3, b"other"), (3, b"other")]
    found = decontaminate.find_leaks(broken, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_an_item_in_a_third_of_the_documents(spark):
    docs, items, want = planted(3, 40, 120)
    text = dict(items)[5]
    docs = [(d, f"{t} {text} and more" if d % 3 == 1 else t) for d, t in docs]
    want |= {(d, 5) for d, _ in docs if d % 3 == 1}
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    print("missed", len(want - set(got)), "of", len(want), "cosine", min(got[k].cosine for k in want & set(got) if k[1] == 5) if want & set(got) else None)
    assert set(got) == want and all(got[k].cosine > decontaminate.LEAST_COSINE for k in want if k[1] == 5)
    # Only words that every document has.
    everywhere = [(d, f"{t} all of these words stand in any one of them") for d, t in docs]
    frame = spark.createDataFrame(everywhere, "doc_id long, text string")
    found = decontaminate.find_leaks(frame, spark.createDataFrame([(1, "All of these words stand in any one of them.")], "item_id long, text string")).collect()
    assert len(found) == len(docs) and all(r.cosine > 0 for r in found)


def test_words_around_a_short_item_do_not_count_against_it(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(15))) for k in range(13)] + [(99, "words that no document of the whole table ever has in it")]
    foreign = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
    docs = [(d, f"{foreign(80)} {items[d % 13][1]} {foreign(80)}") for d in range(2600)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    print("missed", len({(d, d % 13) for d, _ in docs} - got), "of", len(docs))
    assert got == {(d, d % 13) for d, _ in docs}


def test_paraphrase_of_any_passage_with_the_answer_anywhere(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"x{rng.randrange(5000)}" for _ in range(n))
    body = [f"q{k}" for k in range(200)]
    passage = [w if k % 10 < 7 else "changed" for k, w in enumerate(body[:64])]
    answer = "the answer is forty two"
    docs = [
        (1, f"{prose(50)} {' '.join(passage)} {prose(700)} {answer} {prose(40)}"),
        (2, f"{prose(50)} {' '.join(passage)} {prose(700)}"),
        (3, f"{answer} {prose(300)} {' '.join(w if k % 10 < 7 else 'changed' for k, w in enumerate(body[64:128]))}"),
    ]
    items = spark.createDataFrame([(7, " ".join(body), answer)], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 7, "paraphrase"), (3, 7, "paraphrase")}
