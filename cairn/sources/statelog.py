"""State tables without MERGE: an append-only parquet log of
changes; the current state is the latest row per key that is not a delete.

Catalog, artifact and job-state operators return new state DataFrames; a
``StateLog`` persists them as change rows.  A change takes a number in a ``CommitLog``, is written
into a folder of its own (nothing is rewritten in place), and is entered in the log when it is whole.  So several
writers never share a number, the change that began last wins, and one that fails
or is half-way is invisible.  Reading folds the changes with ``latest_per_key`` (partial aggregation per key).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.core import latest_per_key
from cairn.sources.commitlog import CommitLog


class StateLog:
    """One state table: ``keys`` identify a row; ``schema`` is its columns."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.schema = schema
        self._log_schema = f"{schema}, _seq bigint, _deleted boolean"
        self._fields = [(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema.fields]
        self.commits = CommitLog(spark, f"{self.path}/_log")

    def log(self) -> DataFrame:
        """All change rows with their number and whether they delete."""
        folders = [e["folder"] for e in self.commits.entries() if e["kind"] == "done"]
        if not folders:
            return self.spark.createDataFrame([], self._log_schema)
        return self.spark.read.schema(self._log_schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _append(self, rows: DataFrame, deleted: bool) -> int:
        seq = self.commits.append({"kind": "begin"})
        folder = f"change-{seq:012d}-{uuid.uuid4().hex[:12]}"
        (rows.withColumn("_seq", F.lit(seq).cast("bigint")).withColumn("_deleted", F.lit(deleted))
             .write.parquet(f"{self.path}/{folder}"))
        self.commits.append({"kind": "done", "folder": folder})
        return seq

    def upsert(self, rows: DataFrame) -> int:
        """Record new or changed rows (whole rows, as the operators return them)."""
        return self._append(rows.select(*[n for n, _ in self._fields]), False)

    def delete(self, keys: DataFrame) -> int:
        """Record deletes (tombstones) for the given keys."""
        return self._append(keys.select(*[F.col(n) if n in self.keys else F.lit(None).cast(t).alias(n)
                                          for n, t in self._fields]), True)

    def current(self) -> DataFrame:
        """Latest row per key, deletes removed."""
        cols = [n for n, _ in self._fields]
        latest = latest_per_key(self.log(), self.keys, ["_seq"])
        return latest.where(~F.col("_deleted")).select(*cols)

    def compact_to(self, path: str) -> "StateLog":
        """Write the current state as a new log at ``path`` (one row per live
        key, no history) and return it.  Nothing is rewritten in place: the
        caller switches to the new path, and the old one can then be removed."""
        out = StateLog(self.spark, path, self.keys, self.schema)
        out.upsert(self.current())
        return out
