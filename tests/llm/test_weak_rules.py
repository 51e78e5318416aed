import random
import re

import numpy as np

from gradeloom.llm import weak_rules

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    keys = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    many = {k for k in keys if keys.count(k) > 1}
    covered = {p for k, key in enumerate(keys) if key in many for p in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rng = random.Random(4)
    word = lambda: rng.choice(["la", "Été", "b c", "x,", "y#", "zz", " q", "🙂", "a\x1cb"]) + str(rng.randrange(9))
    out = [None, "", " \n\t ", "one", "a " * 9, "a " * 3000, "\n".join(["same line"] * 9 + ["other"]), "x\r\nx\r\nx\x0bx"]
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(60))]
        out.append(rng.choice([" ", "\n", "\t ", "\r\n"]).join(base + base[: rng.randrange(30)] + [word() for _ in range(rng.randrange(30))]))
    return out


def test_counts_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "a b"), (3, "one")]
    frame = spark.createDataFrame([(t, i, 5, True) for i, t in rows], "text string, doc_id long, n_words int, kept boolean")
    got = weak_rules.judge(frame).collect()
    want = sorted((i, *brute(t)) for i, t in rows if i is not None)
    assert sorted(tuple(r)[:7] for r in got if r.doc_id is not None) == want and len(got) == len(rows)
    assert all(not r.kept or not r.base_failed for r in got)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.85
    votes = np.zeros((len(truth), 4), int)
    right = [0.95, 0.9, 0.8, 0.7]
    for k, p in enumerate(right):
        correct = rng.random(len(truth)) < p
        votes[:, k] = np.where(rng.random(len(truth)) < 0.2, 0, np.where(correct == truth, 1, -1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, table = weak_rules.fit_reliabilities(patterns, counts)
    assert abs(good - 0.85) < 0.02
    assert np.allclose([t[1, 2] / (t[1, 0] + t[1, 2]) for t in table], right, atol=0.03)


def test_held_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in weak_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in labels]
    clean = [r for r in got if labels[r.doc_id] == 1 and not r.base_failed]
    junk = [r for r in got if labels[r.doc_id] == 0]
    assert np.mean([r.kept for r in clean]) > 0.99
    assert np.mean([r.kept for r in junk]) < 0.1


def test_empty(spark):
    assert weak_rules.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []
