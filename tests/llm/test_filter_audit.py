"""Filter audit against a row-by-row count."""

import re
from collections import Counter
from itertools import permutations

import pytest

from gradeloom.llm import filter_audit, repeats

LONG = " ".join(f"w{k}" for k in range(250))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (None, LONG, None), (3, None, None), (4, "", ""), (5, "", "a"),
    (6, "same " * 300, "a"), (7, LONG.upper(), "b"), (8, LONG + " $", "b"), (9, "A $ A $", "c"), (9, "other text", "c"), (10, "\t\n ", None),
    (11, "x" * 200_000, "a"), (12, "é " * 500, "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 1, 1), (7, None, 1), (99, 1, 1), (None, 1, 1)]


def brute(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    seen = Counter()
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        conditions = (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i,
        )
        failed = "".join(x for x, yes in zip("ABCDE", conditions) if yes)
        seen[s or "", failed, i in good and i is not None, i in toxic and i is not None] += 1
    out = {}
    for part in {p for p, *_ in seen}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                v = [0] * 6
                for (p, failed, g, b), n in seen.items():
                    if p != part:
                        continue
                    gone, fails = any(y in failed for y in order[:k]), x in failed
                    for at, yes in enumerate((not gone and not fails, not gone and fails, gone and fails, failed == x, not gone and fails and g, not gone and fails and b)):
                        v[at] += n * yes
                out[part, "".join(order), k + 1] = v
                shapley[x] += v[1]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[x])
    return out


@pytest.mark.parametrize("rows", [ROWS, [], [(i, "copy " + LONG, "hot") for i in range(60)] + [(i, f"{LONG} {i}", f"s{i % 3}") for i in range(30)]])
def test_audit(spark, rows, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT_ROWS", 10)  # so that the sixty copies are dealt over several tasks
    docs = spark.createDataFrame([(*r, 1, "z", 5) for r in rows], "doc_id long, text string, source string, bits int, hash string, n long")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in got.collect()}
    assert found == brute(rows, LABELS)


def test_hint_never_misses(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('k', id % 5000) AS key")
    keys = spark.range(100).selectExpr("concat('k', id) AS key")
    marked = repeats.hinted(rows, "key", keys)
    got = marked.groupBy("_maybe").count().collect()
    assert marked.where("NOT _maybe").join(keys, "key").count() == 0
    assert {r["_maybe"]: r["count"] for r in got}[True] < 400 * 1.5


def test_hint_with_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_BITS", 1 << 15)
    keys = spark.range(50_000).selectExpr("id AS key")
    assert repeats.hinted(spark.range(60_000).selectExpr("id AS key"), "key", keys).where("NOT _maybe").join(keys, "key").count() == 0


def test_unique_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"{LONG} {i}", "s") for i in range(50)], "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    plan = filter_audit.combinations(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line)
