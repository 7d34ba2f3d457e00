"""Operator 10, exact deduplication: a streaming job whose keyed state never
expires and lives on disk (RocksDB).

Each document goes through three steps, all in DataFrame and streaming
operations:

1. *Keys.*  One narrow row per document is written to the shared folder: the
   digest of its text, its id and its content locator (source file and id).
2. *State.*  A stream over the keys groups by digest.  The state of a digest
   is one row: how many rows carry it, and the id, row number and locator of the
   row that stays (the largest id).  There is no watermark, so no state is
   ever dropped.  Partial aggregation reduces a digest that a third of all
   rows share before the shuffle.  Each micro-batch writes the digests it
   changed into its own folder (overwritten when a batch is replayed).
3. *Hits.*  Where a digest has several rows, the full bytes of each are
   compared with those of the row that stays, which the locator finds.  Hits
   of a large group are salted over ``salts`` keys, and the stayer's text is
   repeated once per salt, so no task gets a whole group.  Rows whose bytes
   differ although the digests agree are grouped again by digest and text.

Edge cases.  Null text counts as empty, and all empty texts are copies of one
another.  A null id is less than every other id.  Rows with the same id and the
same text are copies like others: exactly one of them is ``kept`` (an arbitrary
one, fixed by the written key table).  An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import table, text_or_empty, written
from cairn.session import STATE_CONF, with_conf, work_dir

KEY_SCHEMA = "id bigint, uid bigint, digest binary, locator string"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def write_keys(docs: DataFrame, path: str, id_col: str, text_col: str, digest: Callable) -> None:
    """One row per document: id, a row number fixed by this write, digest, locator."""
    (docs.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("uid"),
                 digest(text_or_empty(text_col)).alias("digest"), F.input_file_name().alias("locator"))
         .write.mode("append").parquet(path))


def run_state(spark: SparkSession, keys_path: str, state_path: str, checkpoint: str,
              max_bytes_per_trigger: int | None = 1 << 30, max_files_per_trigger: int | None = None) -> None:
    """Feed the key files that are new since the last run through the state.

    The checkpoint remembers the files taken and the state, so calling it again
    after new keys were written continues where it stopped."""
    reader = spark.readStream.schema(KEY_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    elif max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    state = reader.parquet(keys_path).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "uid", "locator")).alias("keep"))

    def write_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id:012d}")

    def run() -> None:
        q = (state.writeStream.outputMode("update").foreachBatch(write_batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()

    with_conf(spark, STATE_CONF, run)


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The latest row of each digest: ``digest, n, keep``."""
    schema = "digest binary, n bigint, keep struct<id:bigint,uid:bigint,locator:string>, batch bigint"
    rows = spark.read.schema(schema).parquet(state_path)
    return (rows.groupBy("digest").agg(F.max_by(F.struct("n", "keep"), "batch").alias("s"))
                .select("digest", "s.n", "s.keep"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable = sha256, salts: int = 32, salt_from: int = 1000,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id, uid, digest, keep_id, keep_uid, group_size``.

    Rows are in one group when their whole texts are equal.  ``digest`` only
    chooses which rows are compared."""
    spark = docs.sparkSession
    root = work_dir(spark, "exact_dedup")
    keys_path, state_path = f"{root}/keys", f"{root}/state"
    write_keys(docs, keys_path, id_col, text_col, digest)
    run_state(spark, keys_path, state_path, f"{root}/checkpoint", max_files_per_trigger=max_files_per_trigger)
    keys = spark.read.schema(KEY_SCHEMA).parquet(keys_path)
    state = read_state(spark, state_path) if has_batches(spark, state_path) else keys.limit(0).select(
        "digest", F.lit(0).cast("bigint").alias("n"), F.struct("id", "uid", "locator").alias("keep"))
    groups = written(keys.join(state, "digest").select(
        "id", "uid", "digest", "locator", "n", F.col("keep.id").alias("keep_id"),
        F.col("keep.uid").alias("keep_uid")), "exact_groups")
    differ = written(hits_that_differ(docs, groups, id_col, text_col, digest, salts, salt_from), "exact_differ")
    plain = groups.select("id", "uid", "digest", "keep_id", "keep_uid", F.col("n").alias("group_size"))
    if differ.isEmpty():
        return plain
    return split_collisions(docs, groups, differ, plain, id_col, text_col, digest)


def has_batches(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def with_text(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, digest: Callable) -> DataFrame:
    """The rows of ``wanted`` (by id and digest) with the text found there."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("tid"), text_or_empty(text_col).alias("content"))
    texts = texts.withColumn("tdigest", digest(F.col("content")))
    return texts.join(wanted, texts.tid.eqNullSafe(wanted.id) & (texts.tdigest == wanted.digest)).drop("tid", "tdigest")


def hits_that_differ(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, digest: Callable,
                     salts: int, salt_from: int) -> DataFrame:
    """Digests under which some hit's bytes differ from those of the row that stays."""
    wanted = groups.where("n > 1").groupBy("id", "digest").agg(
        F.first("keep_id").alias("keep_id"), F.first("n").alias("n"))
    wide = F.col("n") >= salt_from
    found = with_text(docs, wanted, id_col, text_col, digest)
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    hits = (found.where(~stays)
            .withColumn("salt", F.when(wide, F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0).cast("bigint")))
            .select("digest", "salt", "content"))
    keepers = (found.where(stays)
               .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(wide, F.lit(salts - 1)).otherwise(F.lit(0)).cast("bigint"))))
               .select("digest", "salt", F.col("content").alias("kept_content")))
    return (hits.join(keepers, ["digest", "salt"]).where(F.col("content") != F.col("kept_content"))
                .select("digest").distinct())


def split_collisions(docs: DataFrame, groups: DataFrame, differ: DataFrame, plain: DataFrame,
                     id_col: str, text_col: str, digest: Callable) -> DataFrame:
    """Regroup the rows of colliding digests by digest and text."""
    rows = groups.join(differ, "digest", "left_semi")
    texts = with_text(docs, rows.select("id", "digest").distinct(), id_col, text_col, digest).distinct()
    full = rows.select("id", "uid", "digest").join(texts.select(
        F.col("id").alias("tid"), F.col("digest").alias("tdigest"), "content"),
        F.col("id").eqNullSafe(F.col("tid")) & (F.col("digest") == F.col("tdigest"))).drop("tid", "tdigest")
    # Rows that share id and digest but not the text cannot be told apart by
    # their locator, so they are numbered anew from the texts themselves.
    per = full.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("group_size"),
                                                F.max(F.struct("id", "uid")).alias("keep"))
    again = full.join(per, ["digest", "content"]).select(
        "id", "uid", "digest", F.col("keep.id").alias("keep_id"), F.col("keep.uid").alias("keep_uid"), "group_size")
    return plain.join(differ, "digest", "left_anti").unionByName(again)


def keep_rows(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              digest: Callable = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    kept = (result.where("uid = keep_uid").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("stay")))
    have = result.groupBy(F.col("id").alias("hid"), F.col("digest").alias("hdigest")).agg(F.count(F.lit(1)).alias("rows"))
    kept = kept.join(have, kept.id.eqNullSafe(have.hid) & (kept.digest == have.hdigest)).select(
        F.struct("id", "digest", "rows", "stay").alias("__cairn_k"))
    joined = docs.withColumn("__cairn_d", digest(text_or_empty(text_col))).join(
        kept, F.col(id_col).cast("bigint").eqNullSafe(F.col("__cairn_k.id")) & (F.col("__cairn_d") == F.col("__cairn_k.digest")))
    once = joined.where("__cairn_k.rows = 1").select(*[docs[c] for c in docs.columns])
    repeated = joined.where("__cairn_k.rows > 1").dropDuplicates(["__cairn_k", "__cairn_d"]).select(*[docs[c] for c in docs.columns])
    return once.unionByName(repeated)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""
