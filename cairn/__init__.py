"""cairn: governed table replication, catalog, profiling, SQL jobs, job-log and
artifact management, expressed as Spark DataFrame operators."""

from cairn.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
