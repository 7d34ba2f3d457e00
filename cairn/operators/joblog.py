"""Job-log analytics (J1-J10): status views over the sync, query and task
logs, retention and expiry as DataFrame rewrites.

``now`` is always a parameter, never the clock inside an operator, so a rerun
of the same input gives the same output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.core import hours, latest_per_key, ts_lit

# The queue names the task views always list.
KNOWN_QUEUES = ["queries", "sync", "cleanup", "other"]
TASK_STATES = ["active", "reserved", "scheduled"]

_EPOCH = "0001-01-01 00:00:00"


def sync_job_status(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sync jobs with their table's names."""
    names = catalog.select("table_id", "table_name", "schema_name")
    return jobs.join(names, "table_id", "inner").select(
        "job_id", "table_id", "table_name", "schema_name", "strategy", "status",
        "error_message", "started_at", "completed_at", "rows_synced")


def table_sync_status(catalog: DataFrame, jobs: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Every registered table with its sync status (D20): id, status and
    error of its latest job, time and row count of its last completed job (0
    rows if none), and its size in bytes from the table metadata (0 if none).

    Both "latest" picks are ``max_by`` aggregations, partial per partition."""
    order = [F.coalesce("started_at", ts_lit(_EPOCH)), "job_id"]
    latest = latest_per_key(jobs.select("table_id", "job_id", "status", "started_at", "error_message"),
                            ["table_id"], order)
    done = (jobs.where(F.col("status") == "completed").groupBy("table_id")
            .agg(F.max_by(F.struct("completed_at", "rows_synced"),
                          F.struct("completed_at", "job_id")).alias("s")))
    out = (catalog.select("table_id", "table_name", "schema_name")
           .join(latest.select("table_id", F.col("job_id").alias("last_sync_id"),
                               F.col("status").alias("last_sync_status"),
                               F.col("error_message").alias("last_error")), "table_id", "left")
           .join(done, "table_id", "left"))
    size = F.lit(0).cast("bigint")
    if meta is not None:
        out = out.join(meta.select("table_id", F.col("size_bytes").alias("_bytes")), "table_id", "left")
        size = F.coalesce(F.col("_bytes"), size)
    return out.select("table_id", "table_name", "schema_name", "last_sync_id", "last_sync_status",
                      F.col("s.completed_at").alias("last_sync_at"), "last_error",
                      F.coalesce(F.col("s.rows_synced"), F.lit(0)).cast("bigint").alias("row_count"),
                      size.cast("bigint").alias("size_bytes"))


def retention_delete(jobs: DataFrame, now: str, done_hours: int = 24, failed_hours: int = 72) -> DataFrame:
    """Drop completed jobs older than ``done_hours`` and failed ones older
    than ``failed_hours`` (by completed_at, strict <); keep everything else,
    including rows with no completed_at."""
    t = ts_lit(now)
    old_done = (F.col("status") == "completed") & (F.col("completed_at") < t - hours(done_hours))
    old_failed = (F.col("status") == "failed") & (F.col("completed_at") < t - hours(failed_hours))
    return jobs.where(~F.coalesce(old_done | old_failed, F.lit(False)))


def expire_stale(jobs: DataFrame, now: str, max_hours: int = 1, error_col: str = "error_message") -> DataFrame:
    """Running jobs started more than ``max_hours`` before ``now`` become
    failed with "Job timed out" and completed_at = now."""
    t = ts_lit(now)
    stale = F.coalesce((F.col("status") == "running") & (F.col("started_at") < t - hours(max_hours)),
                       F.lit(False))
    return jobs.select(*[
        (F.when(stale, F.lit("failed")).otherwise(F.col(c)).alias(c) if c == "status" else
         F.when(stale, F.lit("Job timed out")).otherwise(F.col(c)).alias(c) if c == error_col else
         F.when(stale, t).otherwise(F.col(c)).alias(c) if c == "completed_at" else F.col(c))
        for c in jobs.columns])


def expired_results(jobs: DataFrame, now: str, max_hours: int = 24) -> DataFrame:
    """Result files of jobs completed before the cutoff (status completed,
    path present); the caller deletes the files and clears the paths (D22)."""
    cutoff = ts_lit(now) - hours(max_hours)
    return (jobs.where((F.col("status") == "completed") & F.col("result_path").isNotNull()
                       & (F.col("completed_at") < cutoff))
            .select("job_id", "result_path", "completed_at"))


def _known_queues(spark) -> DataFrame:
    return spark.createDataFrame([(q,) for q in KNOWN_QUEUES], "queue string")


def queue_stats(tasks: DataFrame) -> DataFrame:
    """Tasks per queue and state; a task without a queue counts as
    "other", an unknown queue keeps its own row, known queues are zero-filled.

    Pivot with fixed state values (no extra pass to find them), then a full
    outer join with the four known names; its inputs are one row per queue."""
    counts = (tasks.withColumn("queue", F.coalesce("queue", F.lit("other")))
              .groupBy("queue").pivot("state", TASK_STATES).count())
    out = counts.join(_known_queues(tasks.sparkSession), "queue", "full_outer")
    return out.select("queue", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s)
                                 for s in TASK_STATES])


def active_by_queue(tasks: DataFrame) -> DataFrame:
    """Active tasks by queue, one row per task (queue, task detail), with
    a row of nulls for a known queue that has none.

    The reference returns one list per queue; a queue can hold a third of all
    tasks, so the list is not collected into one row: the rows stay
    distributed and come out ordered by queue and start time."""
    active = (tasks.where(F.col("state") == "active")
              .select(F.coalesce("queue", F.lit("other")).alias("queue"), "task_id", "name",
                      "worker", F.col("time_start").alias("started")))
    empty = (_known_queues(tasks.sparkSession)
             .join(active.select("queue").distinct(), "queue", "left_anti")
             .select("queue", *[F.lit(None).cast(t).alias(c) for c, t in
                                (("task_id", "string"), ("name", "string"), ("worker", "string"),
                                 ("started", "timestamp_ntz"))]))
    return active.unionByName(empty).orderBy("queue", "started", "task_id")


def worker_status(tasks: DataFrame, pings: DataFrame) -> DataFrame:
    """Every worker seen in the task log, online if it answered the ping,
    with its process count (0 when silent)."""
    workers = tasks.select("worker").distinct()
    return (workers.join(pings.select("worker", "processes"), "worker", "left")
            .select("worker",
                    F.when(F.col("processes").isNotNull(), "online").otherwise("offline").alias("status"),
                    F.coalesce("processes", F.lit(0)).alias("total_processes")))


def worker_totals(tasks: DataFrame, pings: DataFrame) -> DataFrame:
    """J8, totals: workers known (seen in the task log) and workers that
    answered the ping (whether known or not)."""
    seen = tasks.select("worker", F.lit(1).alias("known"), F.lit(None).cast("int").alias("online"))
    answered = pings.select("worker", F.lit(None).cast("int").alias("known"), F.lit(1).alias("online"))
    return (seen.unionByName(answered).where("worker is not null")
            .groupBy("worker").agg(F.max("known").alias("known"), F.max("online").alias("online"))
            .agg(F.count("known").alias("total_workers"), F.count("online").alias("online_workers")))


def task_flags(tasks: DataFrame) -> DataFrame:
    """Per task: status, ready, successful and failed flags; the error
    that a failed one recorded."""
    failed = F.col("status") == "FAILURE"
    return tasks.select(
        "task_id", "status",
        F.col("status").isin("SUCCESS", "FAILURE").alias("ready"),
        (F.col("status") == "SUCCESS").alias("successful"), failed.alias("failed"),
        F.when(failed, F.col("error")).alias("error"))


def sync_statistics(jobs: DataFrame) -> DataFrame:
    """Per table and day: jobs by status, success share of finished
    jobs, rows synced and mean duration of completed jobs in seconds."""
    dur = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    st = F.col("status")
    return (jobs.withColumn("day", F.date_trunc("day", F.coalesce("started_at", "completed_at")).cast("timestamp_ntz"))
            .groupBy("table_id", "day").agg(
                F.count(F.lit(1)).alias("jobs"),
                F.count_if(st == "completed").alias("completed"),
                F.count_if(st == "failed").alias("failed"),
                F.count_if(st == "pending").alias("pending"),
                F.count_if(st == "running").alias("running"),
                F.round(F.count_if(st == "completed") / F.nullif(F.count_if(st.isin("completed", "failed")), F.lit(0)), 6)
                 .alias("success_rate"),
                F.sum("rows_synced").cast("bigint").alias("rows_synced"),
                F.round(F.avg(F.when(st == "completed", dur / 1e6)), 3).alias("mean_duration_s")))
