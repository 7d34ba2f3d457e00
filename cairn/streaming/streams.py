"""Structured Streaming forms of three jobs.

W1 replicates new source files exactly once per micro-batch: each batch is a job of
a ``Replica``, visible once its log entry is there, and done if it is replayed.  W2 counts tasks per queue and state
in event-time windows with a lateness bound.  W3 finds jobs that started but
did not end within an hour with a stream-stream left outer join bounded by
watermarks on both sides (no Python state code).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.operators.sync import Batch, Replica
from cairn.session import STATE_CONF, with_conf

#: Bytes of new source files that one micro-batch takes at most (one file at least).
BATCH_BYTES = 64 << 30


def stream_incremental(spark: SparkSession, source_dir: str, schema: StructType | str,
                       target: str, checkpoint: str, max_files_per_trigger: int | None = None,
                       max_bytes_per_trigger: int = BATCH_BYTES) -> None:
    """Append every new file of ``source_dir`` to the replica at ``target``.

    ``trigger(availableNow=True)`` processes what is there and stops, in
    micro-batches of bounded size; the checkpoint remembers the files already
    taken, so the next run takes only new ones.  A micro-batch is a job of the replica whose id is the checkpoint's
    mark and the batch id: a batch replayed after a failure is a job that is done, a batch that
    was killed half-way has no log entry and is invisible.  A target that another checkpoint has
    written is refused, since its batch ids start again and its files may have been taken already."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    stream_into(reader.parquet(source_dir), target, checkpoint)


def stream_into(src: DataFrame, target: str, checkpoint: str) -> None:
    """Append what a stream has now to the replica at ``target``, each micro-batch as a job of it (see W1)."""
    spark = src.sparkSession
    mark = "c" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    replica = Replica(spark, target)
    if others := [e["job_id"] for e in replica.snapshot().done if e["strategy"] == "stream" and not e["job_id"].startswith(f"{mark}-")]:
        raise ValueError(f"{target} holds batches of another checkpoint ({others[0]}); use that checkpoint or a new target")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        replica.run(f"{mark}-{batch_id:012d}", lambda _: Batch(batch, "stream"))

    q = (src.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_stream_replica(spark: SparkSession, target: str) -> DataFrame:
    return Replica(spark, target).read()


def queue_window_counts(events: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """W2 logic on a (streaming or batch) task-event DataFrame.

    The event time is cast to ``timestamp`` first: a watermark on
    ``timestamp_ntz`` is rejected by the analyzer."""
    ev = (events.select(F.coalesce("queue", F.lit("other")).alias("queue"), "state",
                        F.col("time_start").cast("timestamp").alias("event_time"))
          .withWatermark("event_time", lateness))
    return (ev.groupBy(F.window("event_time", window), "queue", "state").count()
            .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                    "queue", "state", F.col("count").cast("bigint").alias("tasks")))


def stream_queue_stats(spark: SparkSession, source_dir: str, schema: StructType | str,
                       target: str, checkpoint: str, window: str = "1 day",
                       lateness: str = "1 hour") -> None:
    """Windowed task counts, appended to parquet as each window closes
    (watermark = newest event time - lateness)."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    _append(spark, queue_window_counts(src, window, lateness), target, checkpoint)


def _append(spark: SparkSession, rows: DataFrame, target: str, checkpoint: str) -> None:
    """Run a stateful stream to the end of its input into parquet, its state in
    RocksDB.  A stream keeps the number of state partitions of its first run
    (``spark.sql.shuffle.partitions`` then): size it for the keys alive between watermarks."""
    def run() -> None:
        q = (rows.writeStream.outputMode("append").format("parquet").option("path", target)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()

    with_conf(spark, STATE_CONF, run)


def stale_jobs(starts: DataFrame, ends: DataFrame, max_duration: str = "1 hour",
               lateness: str = "1 hour") -> DataFrame:
    """W3 logic: job starts with no end event within ``max_duration``.

    A left outer stream-stream join on job_id with the end constrained to
    [start, start + max_duration]; the time bound lets Spark drop join state
    once the watermark passes it and then emit the unmatched starts."""
    s = (starts.select(F.col("job_id").alias("s_job_id"),
                       F.col("started_at").cast("timestamp").alias("start_time"))
         .withWatermark("start_time", lateness))
    e = (ends.select(F.col("job_id").alias("e_job_id"),
                     F.col("completed_at").cast("timestamp").alias("end_time"))
         .withWatermark("end_time", lateness))
    cond = ((F.col("s_job_id") == F.col("e_job_id"))
            & (F.col("end_time") >= F.col("start_time"))
            & (F.col("end_time") <= F.col("start_time") + F.expr(f"INTERVAL {max_duration}")))
    j = s.join(e, cond, "leftOuter")
    return j.where(F.col("e_job_id").isNull()).select(
        F.col("s_job_id").alias("job_id"), F.col("start_time").cast("timestamp_ntz").alias("started_at"))


def stream_stale_jobs(spark: SparkSession, starts_dir: str, ends_dir: str, start_schema, end_schema,
                      target: str, checkpoint: str, max_duration: str = "1 hour",
                      lateness: str = "1 hour") -> None:
    """Emit each job once it has run over ``max_duration`` without an end."""
    starts = spark.readStream.schema(start_schema).parquet(starts_dir)
    ends = spark.readStream.schema(end_schema).parquet(ends_dir)
    _append(spark, stale_jobs(starts, ends, max_duration, lateness), target, checkpoint)
