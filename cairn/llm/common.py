"""Helpers that the operators of this folder share."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import work_dir

#: The ASCII white space of the word and line rules: blank and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder in the shared root and read it back.

    Cuts the lineage with a table that every executor can reach, so a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bounds of the Arrow batches that Python steps get, so that very long texts
#: don't add up to a batch that a worker can't hold.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
              "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Prepare a session for the Python steps: bounded Arrow batches, and this
    package sent to the executors' workers, once per context."""
    for k, v in BATCH_CONF.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext
    if getattr(sc, "_cairn_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "cairn")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    path = os.path.join(tempfile.mkdtemp(prefix="cairn-ship-"), "cairn_pkg.zip")
    with open(path, "wb") as out:
        out.write(buf.getvalue())
    sc.addPyFile(path)
    sc._cairn_shipped = True


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes (null: empty): Arrow hands these to Python
    without decoding them."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else.  On text that is all ASCII ``lower`` does
    just that, so the slower ``translate`` is left to other text."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, upper, low))


def strip_ascii(col: Column) -> Column:
    """Strip blanks and \\x09-\\x0D from both ends."""
    return F.btrim(col, F.lit(ASCII_SPACE))
