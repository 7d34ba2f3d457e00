"""Scans, staged exports and result sinks.

Reads are lazy ``spark.read`` calls: a predicate given as text becomes a
Catalyst filter that reaches the parquet scan (``PushedFilters``), and only the
columns a later step uses are read.  Writes count rows with an ``Observation``
during the write itself, so no second pass over the data is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet", "json")


#: Rows of a CSV or JSON result file at most, so that no file grows with the result.
RESULT_FILE_ROWS = 1_000_000


def table_path(root: str, table: str, schema: str | None = None) -> str:
    root = root.rstrip("/")
    if schema:
        return f"{root}/{schema}/{table}"
    return f"{root}/{table}.parquet"


def scan(spark: SparkSession, root: str, table: str, schema: str | None = None,
         where: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Read a whole table, optionally under a predicate pushed to the scan."""
    df = spark.read.parquet(table_path(root, table, schema))
    if where:
        df = df.where(F.expr(where))
    if columns:
        df = df.select(*columns)
    return df


def count_rows(df: DataFrame, where: str | None = None) -> DataFrame:
    """S3: row count under the same predicate, as a one-row DataFrame.

    Without a predicate the scan reads no columns."""
    if where:
        df = df.where(F.expr(where))
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def page(df: DataFrame, order_cols: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """``LIMIT n OFFSET k`` under a total order.

    The order must be total, otherwise pages overlap or skip rows; the caller
    passes a unique key.  Spark plans this as a per-partition top-(k+n) heap
    and one small merge, never a full sort."""
    if not order_cols:
        raise ValueError("a page needs a total order")
    out = df.orderBy(*order_cols)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def scan_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int,
              upper: int, num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Parallel read of a database table, split on a numeric column into
    ``num_partitions`` ranges (one connection per task)."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


def stage_export(df: DataFrame, path: str, where: str | None = None) -> tuple[str, int]:
    """Unload a (filtered) table to parquet; rows written come from the
    write itself through an Observation."""
    if where:
        df = df.where(F.expr(where))
    obs = Observation()
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return path, int(obs.get["rows"])


def stage_load(spark: SparkSession, path: str) -> DataFrame:
    """Read the staged parquet back."""
    return spark.read.parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """Save a result as CSV (header), parquet or JSON Lines; return
    row_count, column_count and file_size.

    CSV escapes quotes by doubling and writes timestamps with microseconds; text
    with line breaks stays one record.  Whether any text has one is observed
    during the write: if none has, a ``_singleline`` mark lets readers split
    files.  Text formats get at most ``RESULT_FILE_ROWS`` rows per file."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    obs = Observation()
    broken = F.lit(any(b in c for c in df.columns for b in "\r\n"))
    for name, kind in df.dtypes:
        if kind == "string" and fmt == "csv":
            quoted = "`" + name.replace("`", "``") + "`"
            broken = broken | F.coalesce(F.col(quoted).rlike(r"[\r\n]"), F.lit(False))
    out = df.observe(obs, F.count(F.lit(1)).alias("rows"), F.max(broken).alias("broken")).write.mode("overwrite")
    if fmt != "parquet":
        out = out.option("maxRecordsPerFile", RESULT_FILE_ROWS)
    if fmt == "csv":
        out.option("header", True).option("escape", '"') \
           .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
        if not obs.get["broken"]:
            fs, mark = _file(df.sparkSession, f"{path}/_singleline")
            fs.create(mark, True).close()
    elif fmt == "json":
        out.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    else:
        out.parquet(path)
    return {"path": path, "format": fmt, "row_count": int(obs.get["rows"]),
            "column_count": len(df.columns), "file_size": output_size(df.sparkSession, path)}


def _file(spark: SparkSession, path: str):
    """Hadoop file system and path object of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_result(spark: SparkSession, path: str, fmt: str, schema=None) -> DataFrame:
    """Read a saved result back with its schema (Q6)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        fs, mark = _file(spark, f"{path}/_singleline")
        return (reader.option("header", True).option("escape", '"').option("multiLine", not fs.exists(mark))
                .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))
    if fmt == "json":
        return reader.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return reader.parquet(path)


def file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and modification time of the files below ``path``.  The
    ``binaryFile`` source skips the content column when it is not selected, so
    this reads directory metadata only."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).load(path)
            .select("path", "length", "modificationTime"))


def output_size(spark: SparkSession, path: str) -> int:
    """Sum of the data file sizes of a written result (one bounded number)."""
    row = (file_listing(spark, path).where(~F.col("path").rlike(r"/(_|\.)[^/]*$"))
           .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first())
    return int(row["n"])


def read_content(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Stored artifact content as (path, modificationTime, length, content)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).load(path))
