import random
import re

import numpy as np
from pyspark.sql import functions as F

from gradeloom.llm import components, near_dup


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and docs[i][0] is not None and docs[j][0] is not None:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    smallest = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            smallest[root(k)] = min(i, smallest.get(root(k), i))
    return sorted(
        ((i, len(sets[k]), None if i is None else smallest[root(k)], i is None or smallest[root(k)] == i) for k, (i, _) in enumerate(docs)), key=repr
    )


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["La", "le", "été", "b c", "x,", "y", "Zz"]) + str(rng.randrange(90))
    docs = [(1000 + k, " ".join(word() for _ in range(rng.choice([3, 5, 8, 60, 200])))) for k in range(60)]
    base = [word() for _ in range(150)]
    docs.append((5, " ".join(base)))
    chain = list(base)
    for k in range(40):  # a chain of revisions: the ends have little in common
        for _ in range(3):
            chain[rng.randrange(len(chain))] = word()
        docs.append((700 - k, " ".join(chain)))
    for k in range(60):
        near = list(base)
        for _ in range(rng.randrange(12)):
            near[rng.randrange(len(near))] = word()
        docs.append((300 + k, "\n".join(near).upper() if k % 9 == 0 else " ".join(near)))
    docs += [(50 + k, "Same three words") for k in range(9)] + [(60, "same three"), (61, None), (62, ""), (63, " \t"), (64, "a " * 3000), (65, "a " * 40), (None, " ".join(base)), (5, "another text of the same id entirely"), (66, "another text of the same id entirely")]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(t, i, 0, "k") for i, t in docs], "text string, doc_id long, node int, set_key string").repartition(5)
    got = near_dup.near_duplicates(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs)


def test_blocks_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PAIR_BLOCK", 7)
    docs = corpus()
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs)


def test_drop(spark):
    docs = [(i, t) for i, t in corpus() if i is not None]
    frame = spark.createDataFrame([(i, t, "e") for i, t in docs], "doc_id long, text string, component_id string")
    kept = near_dup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(docs) if r[3])


def test_rows_are_told_apart_by_id_and_text(spark):
    copied, clean = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, copied, "a"), (2, copied, "b"), (2, clean, "c"), (3, clean + " more", "d"), (4, "alone in the world of words", "e")] + [(7, "said again and again and again", "f")] * 5
    rows += [(None, copied, "g"), (None, copied, "g"), (8, None, "h"), (8, None, "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `row` string").repartition(4)
    got = near_dup.drop_near_duplicates(frame)
    assert got.columns == frame.columns
    want = [(1, copied, "a"), (2, clean, "c"), (4, "alone in the world of words", "e"), (7, "said again and again and again", "f"), (None, copied, "g"), (None, copied, "g"), (8, None, "h"), (8, None, "h")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_links_stay_fewer_than_nodes(spark):
    """Groups of 400 and 1,600 near copies: what a bucket returns grows with its nodes, not with their pairs."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    for size in (400, 1600):
        docs = []
        for k in range(size):
            words = list(base)
            for _ in range(rng.randrange(4, 14)):
                words[rng.randrange(200)] = f"x{k}_{rng.randrange(9)}"
            docs.append((k, " ".join(words)))
        rows = near_dup._rows(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
        nodes = near_dup.describe(rows).selectExpr("doc_id AS node", "set_key", "n_shingles", "signature", "doc_id")
        keyed = nodes.select("node", F.inline(near_dup._bucket_keys(F.col("signature"))))
        members = near_dup._members(rows, nodes, nodes.select("node"))
        alone = nodes.select("node", F.col("node").alias("component"))
        buckets = keyed.groupBy("bucket").count().where("count > 1").agg(F.sum("count")).first()[0]
        links = near_dup._cross_component(keyed, nodes, members, alone).persist()
        assert links.count() < buckets
        got = {r.node: r.component for r in components.connected_components(links).collect()}
        want = {i: c for i, _, c, _ in brute(docs[:: size // 400])} if size == 400 else None
        assert want is None or all(got.get(i, i) == c for i, c in want.items())
        links.unpersist()


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(frame).collect() == [] and near_dup.drop_near_duplicates(frame).collect() == []


def test_estimate_and_recall():
    rng = np.random.default_rng(1)
    pool = near_dup._mixed(np.arange(200_000, dtype=np.uint64))
    found, errors = 0, []
    for k in range(300):
        n = int(rng.integers(8, 400))
        shared, total = int(np.ceil(0.75 * n)), n
        picked = rng.choice(pool, total, replace=False)
        only = total - shared
        a, b = picked[: shared + only // 2], np.r_[picked[:shared], picked[shared + only // 2 :]]
        one, two = near_dup.signatures([np.sort(a), np.sort(b)])
        found += bool((one.reshape(near_dup.BANDS, -1) == two.reshape(near_dup.BANDS, -1)).all(1).any())
        errors.append(near_dup.estimate(np.array([(one == two).mean()]), np.array([len(a)]), np.array([len(b)]))[0] - shared / total)
    assert found == 300 and abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.75 - near_dup.LEAST_ESTIMATE
    unrelated = near_dup.signatures([np.sort(pool[:3000]), np.sort(pool[5000:8000])])
    assert near_dup.estimate(np.array([(unrelated[0] == unrelated[1]).mean()]), np.array([3000]), np.array([3000]))[0] < 0.03


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 180)] + [(5, x) for x in range(6, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(9, 9)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {x: root(x) for x in parent}
    assert all(want[k] == v for k, v in got.items()) and all(k in got for k in want if k != want[k])
