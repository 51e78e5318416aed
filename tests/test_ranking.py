"""Distributed ranks against brute force, with one group holding most rows."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gradeloom import session
from gradeloom.operators.progress import progress_marks
from gradeloom.operators.ranking import hash_split, stratified_folds, stratified_split
from test_plans import shuffled_columns


def seeded(i):
    return (hashlib.md5(f"42|{i}".encode()).hexdigest(), i)


def skewed(spark, n=4000):
    """More than half of the rows in one stratum, one stratum of a single row, one without a name."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") == 17, "tiny").when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 < 2, "big").when(F.col("id") % 2 == 0, "mid").otherwise("small").alias("g")
    )


def test_split_is_exact(spark):
    rows = skewed(spark)
    got = {r.id: r.split for r in stratified_split(rows, "id", "g").collect()}
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r.g].append(r.id)
    assert None in groups and len(got) == rows.count()
    for ids in groups.values():
        ids.sort(key=seeded)
        test = int(len(ids) * 0.2 + 0.5)
        val = int(len(ids) * 0.1 + 0.5)
        expected = ["test"] * test + ["val"] * val + ["train"] * (len(ids) - test - val)
        assert [got[i] for i in ids] == expected


def test_split_does_not_shuffle_the_rows(spark):
    split = stratified_split(skewed(spark).withColumn("payload", F.lit("x")), "id", "g")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BroadcastHashJoin" in plan
    assert all("payload" not in columns for columns in shuffled_columns(split))


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "FEW_GROUPS", 2)
    rows = skewed(spark, 500)
    assert stratified_folds(rows, "id", "g").count() == 500 and stratified_split(rows, "id", "g").count() == 500


def test_folds_are_exact(spark):
    rows = skewed(spark, 900)
    got = {r.id: r.fold for r in stratified_folds(rows, "id", "g", k=3).collect()}
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r.g].append(r.id)
    assert None in groups and len(got) == 900
    for ids in groups.values():
        ids.sort(key=seeded)
        assert [got[i] for i in ids] == [n % 3 for n in range(len(ids))]


def test_hash_split_shares(spark):
    counts = Counter(r.split for r in hash_split(spark.range(5000), "id").collect())
    assert abs(counts["test"] / 5000 - 0.2) < 0.03 and abs(counts["val"] / 5000 - 0.1) < 0.03


def test_progress_with_a_hot_instant(spark):
    """A third of all completions share one timestamp."""
    n = 3000
    log = spark.range(n).select(
        F.when(F.col("id") % 7 > 0, "p").alias("provider"),
        F.when(F.col("id") % 5 == 0, "b").when(F.col("id") % 5 == 1, None).otherwise("a").alias("strategy"),
        F.timestamp_seconds(F.when(F.col("id") % 3 == 0, F.lit(1000)).otherwise(F.col("id"))).alias("completed_at"),
    )
    times = defaultdict(list)
    for r in log.select("provider", "strategy", F.unix_seconds("completed_at").alias("t")).collect():
        times[r.provider, r.strategy].append(r.t)
    got = defaultdict(dict)
    for r in progress_marks(log, step=7, levels=4).collect():
        got[r.provider, r.strategy][r.completed] = r.elapsed_sec
    assert len(times) == 6
    for group, ts in times.items():
        ts.sort()
        expected = {k: float(ts[k - 1] - ts[0]) for k in range(1, len(ts) + 1) if k % 7 == 0 or k == len(ts)}
        assert got[group] == expected
