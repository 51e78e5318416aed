"""Streams run in several steps and compared with the same computation over a table."""

import json
import time

from pyspark.sql import functions as F

from gradeloom.streaming import ingest, throughput as tp

LOG = "provider string, strategy string, success boolean, tokens bigint, completed_at timestamp"


def test_windows_over_several_runs_equal_the_batch(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))

    def deliver(first, n):
        spark.range(first, first + n).select(
            F.lit("p").alias("provider"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("strategy"), (F.col("id") % 4 > 0).alias("success"),
            F.col("id").alias("tokens"), F.timestamp_seconds(F.col("id") * 20).alias("completed_at"),
        ).coalesce(1).write.mode("append").parquet(inbox)

    for first, n in ((0, 40), (40, 40), (70, 30)):  # the last delivery overlaps open windows
        deliver(first, n)
        tp.write_windows(tp.throughput(spark.readStream.schema(LOG).parquet(inbox), "1 minute"), out, state).awaitTermination()
    expected = tp.throughput(spark.read.schema(LOG).parquet(inbox), "1 minute")
    got = tp.latest_windows(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def line(identifier, text, status=200):
    body = {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}}
    return json.dumps({"custom_id": identifier, "response": {"status_code": status, "body": body}})


def test_redelivered_files_are_kept_once(spark, tmp_path):
    inbox, out, state = tmp_path / "inbox", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()

    def run():
        ingest.store_stream(ingest.result_stream(spark, str(inbox)), out, state).awaitTermination()

    (inbox / "a.jsonl").write_text("\n".join([line("q0_baseline", "x"), line("q1_baseline", "y"), line("q0_baseline", "x")]))
    run()
    time.sleep(1)
    (inbox / "a-again.jsonl").write_text("\n".join([line("q1_baseline", "y"), line("q2_simple_neural", "z", 500)]))
    run()
    stored = spark.read.parquet(f"{out}/batches")
    assert stored.count() == 3
    got = sorted((r.custom_id, r.question_id, r.strategy, r.status_code) for r in ingest.current_responses(spark, out).collect())
    assert got == [("q0_baseline", 0, "baseline", 200), ("q1_baseline", 1, "baseline", 200), ("q2_simple_neural", 2, "simple_neural", 500)]
