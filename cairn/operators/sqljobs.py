"""SQL jobs (Q1-Q6): ad-hoc SQL over the allowed tables, run as logged jobs
whose results are saved and read back.

A job runs in a session of its own (``allowed_session``) that holds a temp
view for each allowed table and no others.  ``sqlguard`` checks the plan of its text before
anything runs: commands (DDL, DML, SET and so on), files read by path, tables of the
persistent catalog, other sessions' views, scripts and functions that reach
into the JVM are refused.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.sqlguard import Guard
from cairn.sources.io import read_result, write_result

JOB_SCHEMA = ("job_id string, query string, status string, error string, result_path string, "
              "format string, row_count bigint, column_count bigint, file_size bigint")


def register_allowed(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """Expose the allowed tables as temp views (lazy: nothing is read)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


def allowed_session(spark: SparkSession, paths: Mapping[str, str], catalog: DataFrame | None = None,
                    settings: Mapping[str, str] | None = None) -> SparkSession:
    """A session for query jobs: its own temp views, one per allowed parquet table, and Spark ``settings`` of its own.

    With a ``catalog`` (table_name, status) only tables with an active entry
    are exposed.  The matching names come to the driver, no data does."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    # Reads by path (parquet.`/path`) are off.
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for key, value in (settings or {}).items():
        own.conf.set(key, value)
    names = sorted(paths)
    if catalog is not None:
        active = catalog.where((F.col("status") == "active") & F.col("table_name").isin(names))
        names = sorted(r["table_name"] for r in active.select("table_name").distinct().collect())
    for name in names:
        own.read.parquet(paths[name]).createOrReplaceTempView(name)
    return own


def run_sql(spark: SparkSession, text: str, args: Mapping | list | None = None,
            max_rows: int | None = None) -> DataFrame:
    """Q1-Q3: run a query over the registered views, with bound parameters
    (``:name`` with a dict, ``?`` with a list) and an optional row cap.

    The plan is checked first (``sqlguard``): whatever resolves to anything but the session's own
    temp views and Spark's harmless functions is refused with a PermissionError."""
    df = Guard(spark).run(text, args)
    if max_rows is not None:
        df = df.limit(max_rows)
    return df


def query_job_status(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Q4: status, error, result path and row count of the requested jobs."""
    return (jobs.join(ids.select("job_id").distinct(), "job_id", "left_semi")
            .select("job_id", "status", "error", "result_path", "row_count",
                    "created_at", "started_at", "completed_at"))


LOG_SCHEMA = JOB_SCHEMA + ", updated_at timestamp_ntz"


def query_job_log(spark: SparkSession, path: str):
    """A persistent query-job log (a StateLog keyed by job_id): its current
    state is each job's latest status row."""
    from cairn.sources.statelog import StateLog
    return StateLog(spark, path, ["job_id"], LOG_SCHEMA)


def _record(spark: SparkSession, log, row: dict, now) -> None:
    if log is not None:
        import datetime as dt
        at = now if isinstance(now, dt.datetime) else dt.datetime.fromisoformat(str(now))
        log.upsert(spark.createDataFrame([{**row, "updated_at": at}], LOG_SCHEMA))


def run_query_job(spark: SparkSession, job_id: str, text: str, fmt: str, path: str,
                  args: Mapping | list | None = None, log=None, now=None) -> DataFrame:
    """Q5: run a query, save its result, and return the job's log row:
    completed with row and column counts and file size, or failed with the
    whole error text (the failure is data, not an exception).  Commands are
    refused, which is a failed job too.

    With a ``log`` (``query_job_log``) every transition, pending, running and
    then completed or failed, is recorded with ``now`` (a parameter, never
    the clock)."""
    row = {"job_id": job_id, "query": text, "status": "pending", "error": None,
           "result_path": None, "format": fmt, "row_count": None, "column_count": None,
           "file_size": None}
    _record(spark, log, row, now)
    row["status"] = "running"
    _record(spark, log, row, now)
    try:
        df = run_sql(spark, text, args)
        stats = write_result(df, path, fmt)
        row.update(status="completed", result_path=path, row_count=stats["row_count"],
                   column_count=stats["column_count"], file_size=stats["file_size"])
    except Exception as exc:  # the job log records any failure of the query
        row.update(status="failed", error=str(exc).strip() or type(exc).__name__)
    _record(spark, log, row, now)
    return spark.createDataFrame([row], JOB_SCHEMA)


def query_result(spark: SparkSession, job: dict, schema=None) -> DataFrame:
    """Q6: the stored result of a completed job, read back by its format.  A
    job that is not completed has no result: its status row (job_id, status,
    error) comes back instead, as Q4 would give it."""
    if job["status"] != "completed":
        return spark.createDataFrame([(job["job_id"], job["status"], job.get("error"))],
                                     "job_id string, status string, error string")
    return read_result(spark, job["result_path"], job["format"], schema)
