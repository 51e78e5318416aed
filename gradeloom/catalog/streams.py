"""Structured Streaming jobs run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog import data, oracle as o
from gradeloom.catalog.aggregates import PROGRESS
from gradeloom.catalog.expressions import _LINES_CTE, _batch_lines
from gradeloom.catalog.registry import query
from gradeloom.session import scratch_path
from gradeloom.streaming import ingest, marks, throughput as tp


_WINDOWS = o.over("""SELECT time_bucket(INTERVAL 1 HOUR, completed_at) AS window_start, provider, strategy, count(*) AS completed,
 count(*) FILTER (success) AS succeeded, CAST(sum(tokens) AS BIGINT) AS tokens FROM request_log GROUP BY ALL""")


@query("stm_01_throughput", _WINDOWS)
def _(spark, sf):
    """The log arrives out of order, in several batches; what comes later than the watermark is kept beside the windows."""
    inbox, out = scratch_path(spark, "log"), scratch_path(spark, "windows")
    log = data.request_log(spark, sf)
    log.repartition(4, F.xxhash64("event_id")).write.parquet(inbox)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    tp.follow(stream, out, scratch_path(spark, "windows-state"), "1 hour").awaitTermination()
    return tp.followed_windows(spark, out, "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stm_01_windows_as_state", _WINDOWS)
def _(spark, sf):
    schema = data.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    windows = tp.throughput(data.log_columns(events), "1 hour")
    out = scratch_path(spark, "windows")
    run = tp.write_windows(windows, out, scratch_path(spark, "windows-state"))
    run.awaitTermination()
    return tp.latest_windows(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stm_02_result_ingest", o.over(_LINES_CTE + "SELECT custom_id, question_id, strategy, status_code, response, input_tokens, output_tokens, total_tokens FROM lines"))
def _(spark, sf):
    """Every file is delivered twice; each custom id is kept once, and read from the generation that the batches were folded into."""
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "ingested")
    for _delivery in range(2):
        _batch_lines(spark, sf).write.mode("append").json(inbox, compression="gzip")
    run = ingest.store_stream(ingest.result_stream(spark, inbox), out, scratch_path(spark, "ingest-state"))
    run.awaitTermination()
    ingest.compact(spark, out)
    return ingest.current_responses(spark, out)


@query("win_06_progress_stream", PROGRESS)
def _(spark, sf):
    """The log arrives in order, in four batches; every batch adds the marks that it reaches."""
    inbox, out = scratch_path(spark, "log"), scratch_path(spark, "marks")
    log = data.request_log(spark, sf).select("provider", "strategy", "completed_at")
    ends = log.select(F.unix_micros("completed_at").alias("at")).agg(F.percentile_approx("at", [0.25, 0.5, 0.75], 1000)).first()[0]
    for first, last in zip([None, *ends], [*ends, None]):
        at = F.unix_micros("completed_at")
        part = log if first is None else log.where(at > first)
        (part if last is None else part.where(at <= last)).coalesce(1).write.mode("append").parquet(inbox)
    planned = log.groupBy("provider", "strategy").agg(F.count(F.lit(1)).alias("total"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    marks.follow_marks(stream, out, scratch_path(spark, "marks-state"), planned).awaitTermination()
    return marks.all_marks(spark, out)
