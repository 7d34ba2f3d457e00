"""Registered queries: job log."""

from __future__ import annotations

from cairn.operators import joblog
from cairn.plans.fixtures import JOB_CLOCK, Tables
from cairn.plans.registry import register

NOW = f"TIMESTAMP '{JOB_CLOCK}'"

SYNC_COLS = ("job_id, table_id, strategy, status, error_message, started_at, completed_at, "
             "rows_synced, last_value")
QUERY_COLS = "job_id, query, status, created_at, started_at, completed_at, error, result_path, row_count"


@register("sync_job_status", "J1", """
SELECT j.job_id, j.table_id, a.table_name, a.schema_name, j.strategy, j.status, j.error_message,
  j.started_at, j.completed_at, j.rows_synced
FROM sync_jobs j JOIN allowed_tables a ON j.table_id = a.table_id""", fixtures=["sync_jobs", "allowed_tables"])
def sync_job_status(spark, sf):
    t = Tables(spark, sf)
    return joblog.sync_job_status(t["sync_jobs"], t["allowed_tables"])


@register("table_sync_status", "J2", """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id
    ORDER BY coalesce(started_at, TIMESTAMP '0001-01-01') DESC, job_id DESC) AS rn FROM sync_jobs) WHERE rn = 1),
done AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY completed_at DESC, job_id DESC) AS rn
    FROM sync_jobs WHERE status = 'completed') WHERE rn = 1)
SELECT a.table_id, a.table_name, a.schema_name, l.job_id AS last_sync_id, l.status AS last_sync_status,
  d.completed_at AS last_sync_at, l.error_message AS last_error,
  CAST(coalesce(d.rows_synced, 0) AS BIGINT) AS row_count, CAST(coalesce(m.size_bytes, 0) AS BIGINT) AS size_bytes
FROM allowed_tables a LEFT JOIN latest l ON a.table_id = l.table_id LEFT JOIN done d ON a.table_id = d.table_id
LEFT JOIN table_metadata m ON a.table_id = m.table_id""",
          fixtures=["sync_jobs", "allowed_tables", "table_metadata"])
def table_sync_status(spark, sf):
    t = Tables(spark, sf)
    return joblog.table_sync_status(t["allowed_tables"], t["sync_jobs"], t["table_metadata"])


_RETAIN = """
SELECT * FROM {t} WHERE NOT coalesce(
  (status = 'completed' AND completed_at < {now} - INTERVAL '24' HOUR)
  OR (status = 'failed' AND completed_at < {now} - INTERVAL '72' HOUR), false)"""


@register("retention_sync_jobs", "J3", _RETAIN.format(t="sync_jobs", now=NOW), fixtures=["sync_jobs"])
def retention_sync_jobs(spark, sf):
    return joblog.retention_delete(Tables(spark, sf)["sync_jobs"], JOB_CLOCK)


@register("retention_query_jobs", "J3", _RETAIN.format(t="query_jobs", now=NOW), fixtures=["query_jobs"])
def retention_query_jobs(spark, sf):
    return joblog.retention_delete(Tables(spark, sf)["query_jobs"], JOB_CLOCK)


def _stale_sql(table, cols, err):
    out = []
    for c in [x.strip() for x in cols.split(",")]:
        if c == "status":
            out.append("CASE WHEN s THEN 'failed' ELSE status END AS status")
        elif c == err:
            out.append(f"CASE WHEN s THEN 'Job timed out' ELSE {err} END AS {err}")
        elif c == "completed_at":
            out.append(f"CASE WHEN s THEN {NOW} ELSE completed_at END AS completed_at")
        else:
            out.append(c)
    return (f"SELECT {', '.join(out)} FROM (SELECT *, coalesce(status = 'running' AND "
            f"started_at < {NOW} - INTERVAL '1' HOUR, false) AS s FROM {table})")


@register("expire_stale_sync_jobs", "J4", _stale_sql("sync_jobs", SYNC_COLS, "error_message"), fixtures=["sync_jobs"])
def expire_stale_sync_jobs(spark, sf):
    return joblog.expire_stale(Tables(spark, sf)["sync_jobs"], JOB_CLOCK, 1, "error_message")


@register("expire_stale_query_jobs", "J4", _stale_sql("query_jobs", QUERY_COLS, "error"), fixtures=["query_jobs"])
def expire_stale_query_jobs(spark, sf):
    return joblog.expire_stale(Tables(spark, sf)["query_jobs"], JOB_CLOCK, 1, "error")


@register("expired_results", "J5", f"""
SELECT job_id, result_path, completed_at FROM query_jobs
WHERE status = 'completed' AND result_path IS NOT NULL AND completed_at < {NOW} - INTERVAL '24' HOUR""",
          fixtures=["query_jobs"])
def expired_results(spark, sf):
    return joblog.expired_results(Tables(spark, sf)["query_jobs"], JOB_CLOCK)


@register("queue_stats", "J6", """
WITH c AS (
  SELECT coalesce(queue, 'other') AS queue,
    count(*) FILTER (WHERE state = 'active') AS active,
    count(*) FILTER (WHERE state = 'reserved') AS reserved,
    count(*) FILTER (WHERE state = 'scheduled') AS scheduled
  FROM task_events GROUP BY coalesce(queue, 'other')),
k AS (SELECT * FROM (VALUES ('queries'), ('sync'), ('cleanup'), ('other')) AS v(queue))
SELECT coalesce(c.queue, k.queue) AS queue, CAST(coalesce(active, 0) AS BIGINT) AS active,
  CAST(coalesce(reserved, 0) AS BIGINT) AS reserved, CAST(coalesce(scheduled, 0) AS BIGINT) AS scheduled
FROM c FULL OUTER JOIN k ON c.queue = k.queue""", fixtures=["task_events"])
def queue_stats(spark, sf):
    return joblog.queue_stats(Tables(spark, sf)["task_events"])


@register("active_by_queue", "J7", """
WITH a AS (SELECT coalesce(queue, 'other') AS queue, task_id, name, worker, time_start AS started
           FROM task_events WHERE state = 'active'),
k AS (SELECT * FROM (VALUES ('queries'), ('sync'), ('cleanup'), ('other')) AS v(queue))
SELECT * FROM a
UNION ALL
SELECT k.queue, NULL, NULL, NULL, CAST(NULL AS TIMESTAMP) FROM k WHERE k.queue NOT IN (SELECT queue FROM a)""",
          fixtures=["task_events"])
def active_by_queue(spark, sf):
    return joblog.active_by_queue(Tables(spark, sf)["task_events"])


@register("worker_status", "J8", """
SELECT w.worker, CASE WHEN p.processes IS NOT NULL THEN 'online' ELSE 'offline' END AS status,
  coalesce(p.processes, 0) AS total_processes
FROM (SELECT DISTINCT worker FROM task_events) w LEFT JOIN worker_pings p ON w.worker = p.worker""",
          fixtures=["task_events", "worker_pings"])
def worker_status(spark, sf):
    t = Tables(spark, sf)
    return joblog.worker_status(t["task_events"], t["worker_pings"])


@register("worker_totals", "J8", """
SELECT (SELECT count(DISTINCT worker) FROM task_events) AS total_workers,
  (SELECT count(DISTINCT worker) FROM worker_pings) AS online_workers""",
          fixtures=["task_events", "worker_pings"])
def worker_totals(spark, sf):
    t = Tables(spark, sf)
    return joblog.worker_totals(t["task_events"], t["worker_pings"])


@register("task_flags", "J9", """
SELECT task_id, status, status IN ('SUCCESS', 'FAILURE') AS ready, status = 'SUCCESS' AS successful,
  status = 'FAILURE' AS failed, CASE WHEN status = 'FAILURE' THEN error END AS error
FROM task_events""", fixtures=["task_events"])
def task_flags(spark, sf):
    return joblog.task_flags(Tables(spark, sf)["task_events"])


@register("sync_statistics", "J10", """
SELECT table_id, date_trunc('day', coalesce(started_at, completed_at)) AS day, count(*) AS jobs,
  count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running,
  round(count(*) FILTER (WHERE status = 'completed')
        / nullif(count(*) FILTER (WHERE status IN ('completed', 'failed')), 0), 6) AS success_rate,
  CAST(sum(rows_synced) AS BIGINT) AS rows_synced,
  round(avg(CASE WHEN status = 'completed' THEN (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 END), 3)
    AS mean_duration_s
FROM sync_jobs GROUP BY table_id, date_trunc('day', coalesce(started_at, completed_at))""", fixtures=["sync_jobs"])
def sync_statistics(spark, sf):
    return joblog.sync_statistics(Tables(spark, sf)["sync_jobs"])
