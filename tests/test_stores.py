"""The bucketed response cache: lookups, merges, files read and files kept."""

import os
import random
from datetime import datetime, timedelta

import pytest

from gradeloom.stores import response_cache as cache

SCHEMA = "question_id bigint, question string, provider string, timestamp timestamp, response string, success boolean, error string, attempts int"
START = datetime(2024, 1, 1)


def row(question, provider, minute, text):
    return (question, f"q{question}", provider, START + timedelta(minutes=minute), text, True, None, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(spark, path):
    return {(r.provider, r.question_id): (r.timestamp, r.response) for r in cache.entries(spark, path).collect()}


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def merged(before, rows):
    out = dict(before)
    for q, _, p, at, text, *_ in rows:
        if (p, q) not in out or at >= out[p, q][0]:
            out[p, q] = (at, text)
    return out


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    path, want = str(tmp_path / "c"), {}
    cache.create(spark, path, 8)
    assert state(spark, path) == {}
    for step in range(4):
        seen, rows = set(), []
        for _ in range(120):
            key = (rng.randrange(60), rng.choice("abc"), rng.randrange(9) + 2 * step)
            if key not in seen:
                seen.add(key)
                rows.append(row(*key, f"{step}-{key}"))
        rows += [row(7, "a", 50 + step, "hot")] * 300
        cache.upsert(spark, path, frame(spark, rows).repartition(3))
        want = merged(want, rows)
        assert state(spark, path) == want
    cache.upsert(spark, path, frame(spark, []))
    cache.upsert(spark, path, frame(spark, [row(7, "a", 0, "too old")]))
    assert state(spark, path) == want


def test_untouched_buckets_keep_their_files_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    cache.create(spark, path, 16)
    cache.upsert(spark, path, frame(spark, [row(k, "a", 0, f"t{k}") for k in range(200)]))
    before = files(f"{path}/entries")
    new = [row(3, "a", 5, "new"), row(3, "b", 5, "other provider"), row(4, "a", -5, "older than what is there")]
    cache.upsert(spark, path, frame(spark, new))
    after = files(f"{path}/entries")
    gone = set(before) - set(after)
    assert len({os.path.dirname(f) for f in gone}) == 1 and all(before[f] == after[f] for f in set(before) & set(after))
    held = state(spark, path)
    cache.upsert(spark, path, frame(spark, new))
    assert state(spark, path) == held and held["a", 3][1] == "new" and held["a", 4][1] == "t4"


def test_ties_are_settled_alike_in_any_order(spark, tmp_path):
    rows = [row(1, "a", 0, text) for text in ("x", "y", "z")]
    results = set()
    for k, order in enumerate((rows, rows[::-1], rows[1:] + rows[:1])):
        path = str(tmp_path / f"c{k}")
        cache.create(spark, path, 4)
        cache.upsert(spark, path, frame(spark, order).repartition(2))
        results.add(state(spark, path)["a", 1][1])
    assert len(results) == 1


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "c")
    cache.create(spark, path, 32)
    cache.upsert(spark, path, frame(spark, [row(k, p, 0, f"{p}{k}") for k in range(500) for p in "abc"]))
    found = cache.lookup(spark, path, "b", 77)
    (hit,) = found.collect()
    assert (hit.provider, hit.question_id, hit.response) == ("b", 77, "b77")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(provider" in plan and "EqualTo(question_id,77)" in plan
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    metrics = scan.metrics()
    assert metrics.apply("numFiles").value() == 1 and metrics.apply("numPartitions").value() == 1
    assert len(files(f"{path}/entries")) >= 64
    assert cache.lookup(spark, path, "b", 10_000).collect() == [] and cache.lookup(spark, path, "zz", 77).collect() == []


def test_bloom_filters_fit_small_files(spark, tmp_path):
    path = str(tmp_path / "c")
    cache.create(spark, path, 4)
    cache.upsert(spark, path, frame(spark, [row(3 * k, "a", 0, f"t{k}") for k in range(400)]).repartition(4))
    written = files(f"{path}/entries")
    assert written and max(os.path.getsize(f) for f in written) < 20_000
    for number, want in ((0, ["t0"]), (600, ["t200"]), (1197, ["t399"]), (601, []), (1200, [])):
        assert [r.response for r in cache.lookup(spark, path, "a", number).collect()] == want


def test_a_cache_is_made_once(spark, tmp_path):
    path = str(tmp_path / "c")
    cache.create(spark, path, 4)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        cache.create(spark, path, 4)
    assert cache.bucket_count(spark, path) == 4
