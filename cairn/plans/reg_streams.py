"""Registered queries: streams (W1-W3).  Each writes its input as file drops
below a fresh work folder, runs the stream to the end of the available input
(``availableNow``) and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans.fixtures import Tables
from cairn.plans.registry import register
from cairn.session import work_dir
from cairn.sources import io
from cairn.streaming import streams


@register("stream_incremental", "W1", "SELECT * FROM events")
def stream_incremental(spark, sf):
    root = work_dir(spark, "w1")
    src, target, ckpt = f"{root}/source", f"{root}/replica", f"{root}/_checkpoint"
    events = io.scan(spark, sf, "events")
    # Two file drops with a restart in between: the second run takes only the
    # new files; a third run without new files appends nothing.
    events.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).write.mode("append").parquet(src)
    streams.stream_incremental(spark, src, events.schema, target, ckpt)
    events.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).write.mode("append").parquet(src)
    streams.stream_incremental(spark, src, events.schema, target, ckpt)
    streams.stream_incremental(spark, src, events.schema, target, ckpt)
    return streams.read_stream_replica(spark, target)


@register("stream_queue_stats", "W2", """
WITH w AS (
  SELECT date_trunc('day', time_start) AS window_start, date_trunc('day', time_start) + INTERVAL '1' DAY AS window_end,
    coalesce(queue, 'other') AS queue, state, count(*) AS tasks
  FROM task_events GROUP BY ALL)
SELECT * FROM w WHERE window_end <= (SELECT max(time_start) FROM task_events) - INTERVAL '1' HOUR""",
          fixtures=["task_events"])
def stream_queue_stats(spark, sf):
    root = work_dir(spark, "w2")
    src, target, ckpt = f"{root}/source", f"{root}/out", f"{root}/_checkpoint"
    tasks = Tables(spark, sf)["task_events"]
    tasks.write.mode("append").parquet(src)
    streams.stream_queue_stats(spark, src, tasks.schema, target, ckpt, "1 day", "1 hour")
    return spark.read.parquet(target)


@register("stream_stale_jobs", "W3", """
WITH s AS (SELECT job_id, started_at FROM sync_jobs WHERE started_at IS NOT NULL),
e AS (SELECT job_id, completed_at FROM sync_jobs WHERE completed_at IS NOT NULL),
wm AS (SELECT least((SELECT max(started_at) FROM s), (SELECT max(completed_at) FROM e)) - INTERVAL '1' HOUR AS w)
SELECT s.job_id, s.started_at FROM s
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.job_id = s.job_id
                  AND e.completed_at BETWEEN s.started_at AND s.started_at + INTERVAL '1' HOUR)
  AND s.started_at + INTERVAL '1' HOUR < (SELECT w FROM wm)""", fixtures=["sync_jobs"])
def stream_stale_jobs(spark, sf):
    root = work_dir(spark, "w3")
    jobs = Tables(spark, sf)["sync_jobs"]
    starts = jobs.where(F.col("started_at").isNotNull()).select("job_id", "started_at")
    ends = jobs.where(F.col("completed_at").isNotNull()).select("job_id", "completed_at")
    starts.write.mode("append").parquet(f"{root}/starts")
    ends.write.mode("append").parquet(f"{root}/ends")
    streams.stream_stale_jobs(spark, f"{root}/starts", f"{root}/ends", starts.schema, ends.schema,
                              f"{root}/out", f"{root}/_checkpoint")
    return spark.read.parquet(f"{root}/out")
