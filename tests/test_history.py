"""Marks, late rows, compaction and run states against passes over whole tables."""

import json
import random

from pyspark.sql import functions as F

from gradeloom.operators import merge
from gradeloom.operators.progress import progress_marks
from gradeloom.plans import history, report
from gradeloom.streaming import ingest, marks, throughput as tp

LOG = "provider string, strategy string, success boolean, tokens bigint, completed_at timestamp"


def log(spark, first, n):
    return spark.range(first, first + n).select(
        F.when(F.col("id") % 11 == 0, None).otherwise("p").alias("provider"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("strategy"),
        (F.col("id") % 4 > 0).alias("success"), F.col("id").alias("tokens"), F.timestamp_seconds(F.floor(F.col("id") / 7) * 20).alias("completed_at"),
    )


def test_marks_over_many_triggers_equal_the_table(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    borders = [0, 70, 77, 700, 707, 1400, 1500]
    whole = log(spark, 0, 1500)
    planned = whole.groupBy("provider", "strategy").agg(F.count(F.lit(1)).alias("total"))
    for first, last in zip(borders, borders[1:]):
        log(spark, first, last - first).repartition(3).write.mode("append").parquet(inbox)
        marks.follow_marks(spark.readStream.schema(LOG).parquet(inbox), out, state, planned).awaitTermination()
    got = sorted(map(repr, marks.all_marks(spark, out).collect()))
    assert got == sorted(map(repr, progress_marks(whole).collect())) and len(got) > 25
    last = len(borders) - 2
    before = sorted(map(repr, spark.read.parquet(f"{out}/totals/batch_id={last}").collect()))
    marks.mark_batch(log(spark, borders[-2], borders[-1] - borders[-2]), last, out, planned)  # a replay
    assert sorted(map(repr, spark.read.parquet(f"{out}/totals/batch_id={last}").collect())) == before
    assert sorted(map(repr, marks.all_marks(spark, out).collect())) == got


def test_windows_and_late_rows_equal_the_batch(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    parts = [(0, 200), (900, 300), (200, 300), (1200, 50), (500, 400)]  # the third and the last come far too late
    for first, n in parts:
        log(spark, first, n).repartition(2).write.mode("append").parquet(inbox)
        tp.follow(spark.readStream.schema(LOG).parquet(inbox), out, state, "1 minute", "5 minutes").awaitTermination()
    want = sorted(map(repr, tp.throughput(spark.read.schema(LOG).parquet(inbox), "1 minute").select("window_start", "provider", "strategy", "completed", "succeeded", "tokens").collect()))
    assert sorted(map(repr, tp.followed_windows(spark, out).collect())) == want
    told = sorted((r.batch_id, r.rows, r.late) for r in tp._batches(spark, out).collect())
    assert [r for _, r, _ in told] == [n for _, n in parts] and told[0][2] == told[1][2] == 0 and told[2][2] == 300 and told[4][2] > 0
    assert tp.late_rows(spark, out).count() == sum(late for *_, late in told)
    in_time = tp.followed_windows(spark, out, with_late=False).agg(F.sum("completed")).first()[0]
    assert in_time == sum(n for _, n in parts) - sum(late for *_, late in told)
    tp.store_batch(log(spark, 500, 400), 4, out, "1 minute", "5 minutes")  # a replay
    assert sorted(map(repr, tp.followed_windows(spark, out).collect())) == want


def test_an_empty_batch(spark, tmp_path):
    tp.store_batch(log(spark, 0, 0), 0, str(tmp_path), "1 minute", "5 minutes")
    assert tp.followed_windows(spark, str(tmp_path)).collect() == []


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "custom_id string, response string, arrived timestamp"
    rng, want, stamps = random.Random(1), {}, {}

    def deliver(batch):
        rows = []
        for _ in range(20):
            key, at = f"q{rng.randrange(40)}", rng.randrange(1000)
            rows.append((key, f"{batch}-{key}-{at}", at))
            if (at, batch) >= stamps.get(key, (-1, -1)) and not any(r[0] == key for r in rows[:-1]):
                stamps[key], want[key] = (at, batch), rows[-1][1]
            elif any(r[0] == key for r in rows[:-1]):
                rows.pop()
        frame = spark.createDataFrame([(k, t, None) for k, t, _ in rows], "custom_id string, response string, x string").drop("x")
        times = spark.createDataFrame([(k, a) for k, _, a in rows], "custom_id string, a long")
        frame.join(times, "custom_id").select("custom_id", "response", F.timestamp_seconds("a").alias("arrived")).coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch}")

    def state():
        return {r.custom_id: r.response for r in ingest.current_responses(spark, path).collect()}

    for batch in range(12):
        deliver(batch)
    assert state() == want and ingest.compact(spark, path) == 1 and ingest.compact(spark, path) is None
    reader = ingest.current_responses(spark, path)  # opened before what follows
    opened = reader.inputFiles()
    assert opened and all("/generations/generation=1/" in f for f in opened)
    seen = dict(want)
    for batch in range(12, 15):
        deliver(batch)
    assert state() == want
    spark.range(1).write.parquet(f"{path}/generations/generation=2")  # a compaction that failed half-way
    assert state() == want and ingest.compact(spark, path) == 2
    for batch in range(15, 17):
        deliver(batch)
    assert state() == want and ingest.compact(spark, path) == 3 and state() == want
    assert {r.custom_id: r.response for r in reader.collect()} == seen
    unneeded = {f.folder.rsplit("/", 1)[1] for f in ingest.obsolete_folders(spark, path).collect()}
    assert unneeded == {f"batch_id={k}" for k in range(15)} | {"generation=1"}


def test_states_of_runs_add_up(spark, tmp_path, make_responses):
    rng = random.Random(3)
    runs = []
    for run in range(4):
        rows = [
            {"question_id": k, "provider": rng.choice(["openai", "gemini"]), "strategy": rng.choice(["baseline", "roberta"]), "response": rng.choice(["Answer: A", "Answer: C", "", "hm", "API Error: x"]),
             "success": rng.random() < 0.8, "output_tokens": rng.choice([None, rng.randrange(1000)])}
            for k in range(400)
        ]
        rows += [{"question_id": 900, "provider": "claude", "success": False, "output_tokens": 7}]
        graded = report.response_facts(make_responses(*rows), spark.createDataFrame([(k, k % 4) for k in range(400)], "question_id bigint, answer int"), "success", "output_tokens")
        history.add_run(graded, str(tmp_path), f"r{run}")
        runs.append((rows, graded))
    history.add_run(runs[2][1], str(tmp_path), "r2")  # again
    for chosen in (None, ["r1", "r3"]):
        some = [runs[k] for k in ((0, 1, 2, 3) if chosen is None else (1, 3))]
        graded = some[0][1]
        for _, more in some[1:]:
            graded = graded.unionByName(more)
        want = {(r.provider, r.strategy): r.asDict() for r in history.funnel(graded).collect()}
        got = {(r.provider, r.strategy): r.asDict() for r in history.across_runs(spark, str(tmp_path), chosen).collect()}
        assert set(got) == set(want) and all(got[k][c] == want[k][c] for k in want for c in history._FUNNEL)
        for key, row in got.items():
            rows = [x for part, _ in some for x in part if (x["provider"], x.get("strategy", "baseline")) == key]
            tokens = sorted((x["output_tokens"] or 0) for x in rows if x["success"])
            assert row["failed_responses"] == sum(not x["success"] for x in rows)
            if not tokens:
                assert row["median_tokens"] is None
                continue
            assert (row["min_tokens"], row["max_tokens"], row["tokens_20_100"]) == (tokens[0], tokens[-1], sum(20 <= t < 100 for t in tokens))
            near = max(1, int(history.RANK_ERROR * len(tokens)) + 1)
            middle = len(tokens) // 2
            assert tokens[max(0, middle - near)] <= row["median_tokens"] <= tokens[min(len(tokens) - 1, middle + near)]


def test_first_responses(spark, make_responses, monkeypatch):
    monkeypatch.setattr(merge, "FREQUENT_ROWS", 20)
    rng = random.Random(4)
    rows = [{"provider": rng.choice("abc"), "question_id": rng.randrange(9), "question": "q", "response": f"r{k}", "position": rng.choice([k, k, k // 5])} for k in range(300)]
    rows += [{"provider": "a", "question_id": 3, "response": f"hot {k}", "position": 1000 + k} for k in range(200)] + [{"provider": None, "question_id": 1, "response": "x"}] * 3
    frame = make_responses(*rows).repartition(4)
    best = {}
    for r in frame.collect():
        best.setdefault((r.provider, r.question_id), []).append((r.position, r.response))
    got = merge.first_response(frame, "position").collect()
    assert len(got) == len(best) and all((min(p for p, _ in best[r.provider, r.question_id]), r.response) in best[r.provider, r.question_id] for r in got)
    merged = merge.merged_questions(frame, ["b", "a"], "position").collect()
    first = {(r.provider, r.question_id): r.response for r in got}
    assert {(p, m.question_id, v.response) for m in merged for p, v in m.responses.items()} == {(p, q, t) for (p, q), t in first.items() if p in ("a", "b")}
    same = merge.merge_questions(merge.first_response(frame, "position"), ["b", "a"]).collect()
    assert sorted(map(repr, same)) == sorted(map(repr, merged))


def test_merged_questions_shuffle_the_text_once(spark, tmp_path, make_responses):
    make_responses({}, {"question_id": 1}).write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge.merged_questions(rows, ["openai"], "position")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = plan.toString()
    assert "SortAggregate" not in text
    carrying = 0
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
        output = node.output().mkString(",")
        carrying += node.nodeName() == "Exchange" and "response#" in output
    assert carrying == 1, text
