"""Deep pages (S4): a page index, so that a page at any depth opens only the parts it needs.

``PageIndex.build`` sorts a table once by a total order into range partitions of about ``TASK_ROWS`` rows, whose writers
begin a new file after each ``part_rows`` rows.  A file is a part; the index notes its rows and its first and last key
(a few values per part).  A page by offset finds its parts by adding up the counts;
a page by key (``after``) finds them by their first and last keys; either reads only those files, and sorts only
their rows.  ``part_rows`` bounds a part, so a page of n rows reads at most ``n + 2 * part_rows`` rows at any depth.
The number of tasks, and what they report to the driver, goes with the rows over ``TASK_ROWS``, however small the parts.

The index is of the table as it was when built: a changed table is indexed anew, into another folder.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one task sorts and writes, if parts are smaller.
TASK_ROWS = 500_000


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class PageIndex:
    """The pages of a table below ``path``, in ascending order (nulls first) of ``order_cols``."""

    def __init__(self, spark: SparkSession, path: str, order_cols: Sequence[str]):
        self.spark, self.path, self.order = spark, path.rstrip("/"), list(order_cols)
        schema = spark.read.text(f"{self.path}/schema").first()
        self.schema = T.StructType.fromJson(json.loads(schema["value"]))
        index = spark.read.parquet(f"{self.path}/index").orderBy("task", "file").collect()
        #: In order: each part's file and its rows.
        self.parts = [(r["name"], r["n"]) for r in index]
        self.keys = [(tuple(r["first"]), tuple(r["last"])) for r in index]

    @classmethod
    def build(cls, df: DataFrame, order_cols: Sequence[str], path: str, part_rows: int = 1_000_000) -> "PageIndex":
        """Sort ``df`` into parts and index them.  The order must be total, otherwise pages overlap or skip rows."""
        if not order_cols:
            raise ValueError("a page needs a total order")
        spark, order = df.sparkSession, [_q(c) for c in order_cols]
        rows = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
        tasks = max(1, math.ceil(rows / max(part_rows, TASK_ROWS)))
        (df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
           .write.option("maxRecordsPerFile", part_rows).parquet(f"{path}/rows"))
        # Files are named part-<task>-...-c<number of the file in its task>.
        name, key = F.col("_metadata.file_name"), F.struct(*order)
        written = spark.read.schema(df.schema).parquet(f"{path}/rows").select(name.alias("name"), key.alias("key"))
        (written.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
                .withColumn("task", F.regexp_extract("name", r"^part-(\d+)-", 1).cast("bigint"))
                .withColumn("file", F.regexp_extract("name", r"-c(\d+)\.[^/]*$", 1).cast("bigint"))
                .coalesce(1).write.parquet(f"{path}/index"))
        spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")
        return cls(spark, path, order_cols)

    def _read(self, parts: Sequence[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        # The parts' files by name: the others aren't even listed.
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{p}" for p in parts])

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order."""
        at, skip, wanted = 0, 0, []
        for part, n in self.parts:
            if at + n > offset and at < offset + limit:
                if not wanted:
                    skip = offset - at
                wanted.append(part)
            at += n
        return self._read(wanted).orderBy(*[_q(c) for c in self.order]).offset(skip).limit(limit) if wanted else self._read([])

    def after(self, key: Sequence | None, limit: int) -> DataFrame:
        """The first ``limit`` rows whose key comes after ``key`` (None: from the start): the page after one whose last row has that key."""
        if key is None:
            return self.page(limit)
        key = tuple(key)
        wanted, rows = [], 0
        for (part, n), (_, last) in zip(self.parts, self.keys):
            if _before(key, last) and rows < limit:
                # Of the first such part some rows may lie before the key, so it doesn't count.
                rows += n if wanted else 0
                wanted.append(part)
        later, equal = F.lit(False), F.lit(True)
        types = {f.name: f.dataType for f in self.schema.fields}
        for name, value in zip(self.order, key):
            col, at = _q(name), F.lit(value).cast(types[name])
            greater = col.isNotNull() if value is None else col > at
            later = later | (equal & F.coalesce(greater, F.lit(False)))
            equal = equal & col.eqNullSafe(at)
        return self._read(wanted).where(later).orderBy(*[_q(c) for c in self.order]).limit(limit) if wanted else self._read([])


def _before(a: tuple, b: tuple) -> bool:
    """Whether key a sorts before key b, nulls first."""
    for x, y in zip(a, b):
        if x is None and y is None or x == y:
            continue
        return x is None or y is not None and x < y
    return False
