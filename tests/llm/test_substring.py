import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from gradeloom.llm import substring


def brute(docs, width):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    smallest = {}
    for i, ws in words:
        if i is None:
            continue
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k : k + width])
            smallest[key] = min(i, smallest.get(key, i))
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - width + 1 if i is not None else 0):
            if smallest[tuple(ws[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(["la", "le", "Été", "b\u00a0c", "x,", "y", "zz", "q1"]) + str(rng.randrange(40))
    base = [word() for _ in range(300)]
    docs = [(1, " ".join(base)), (2, "\t".join(base[50:200]) + "\n" + " ".join(word() for _ in range(30)))]
    docs += [(3, " ".join(base)), (7, "  " + " ".join(word() for _ in range(9)) + " "), (5, None), (6, ""), (8, " \n ")]
    docs += [(9, " ".join(base[:50])), (10, " ".join(base[:49])), (None, " ".join(base)), (3, " ".join(base[100:220]))]
    docs += [(20 + k, " ".join([*base[100:170], *(word() for _ in range(40)), *base[100:170]])) for k in range(60)]
    docs += [(200, "a " * 5000), (201, "a " * 60), (-4, " ".join(base[120:180]))]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(t, i, 0, "s") for i, t in docs], "text string, doc_id long, bucket int, kind string").repartition(5)
    got = substring.remove_repeats(frame).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, 50)


def test_the_hash_is_sparks(spark):
    ids = np.array([0, 1, -5, 2**62, 17], np.int64)
    got = spark.createDataFrame([(int(i), 3) for i in ids], "i long, s long").select(F.xxhash64("i", "s").alias("h")).collect()
    assert [r.h for r in got] == substring._mixed(np.full(5, 3), substring._mixed(ids, 42)).tolist()


def test_ids_in_a_stride_fill_all_groups(spark):
    groups = 2 * 8 + 1
    ids = np.arange(0, 4000 * groups, groups)
    per = np.bincount(substring._mixed(np.zeros(len(ids), np.int64), substring._mixed(ids, 42)) % groups, minlength=groups)
    assert per.min() > 0.5 * len(ids) / groups and per.max() < 1.5 * len(ids) / groups
    docs = [(i * groups, t) for i, t in corpus() if i is not None]
    got = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, 50)


def test_rows_of_a_hot_id_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(substring, "FREQUENT_ROWS", 20)
    monkeypatch.setattr(substring, "GROUP_BYTES", 2000)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 3000)
    docs = corpus()
    rng = random.Random(8)
    base = docs[0][1].split()
    docs += [(12, " ".join([*base[k : k + 60], *(str(rng.random()) for _ in range(20))])) for k in range(120)] + [(12, docs[0][1])] * 30
    got = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, 50)


def test_bytes_that_are_not_text(spark):
    frame = spark.createDataFrame([(1, b"a \xff b")], "doc_id long, text binary")
    (row,) = substring.remove_repeats(frame, with_text=True).collect()
    assert row.n_words == 3 and row.kept_text == "a \ufffd b" and row.kept_sha256 == hashlib.sha256(b"a \xff b").hexdigest()


def test_small_width_and_text(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = substring.remove_repeats(frame, width=3, with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(docs, 3)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
