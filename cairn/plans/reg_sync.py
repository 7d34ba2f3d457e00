"""Registered queries: replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import sync
from cairn.plans.fixtures import Tables
from cairn.plans.registry import register
from cairn.session import work_dir
from cairn.sources import io

ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@register("sync_full", "Y1", "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def sync_full(spark, sf):
    rep = sync.Replica(spark, work_dir(spark, "replica"), "orders")
    src = io.scan(spark, sf, "orders")
    sync.sync_full(rep, src, "jfull0001", where="o_orderstatus <> 'P'")
    # A second full run replaces the first: twice is the same as once.
    sync.sync_full(rep, src, "jfull0002", where="o_orderstatus <> 'P'")
    return rep.read()


@register("sync_incremental", "Y2", "SELECT * FROM events")
def sync_incremental(spark, sf):
    rep = sync.Replica(spark, work_dir(spark, "replica"), "events")
    events = io.scan(spark, sf, "events")
    # First run: the source as it stood on 15 January; no watermark yet, so
    # everything is copied.  Second run: the grown source, from the watermark
    # on ts.  Third run: nothing new, nothing appended, watermark kept.
    as_of_jan15 = events.where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    sync.sync_incremental(rep, as_of_jan15, "ts", "jinc0001")
    sync.sync_incremental(rep, events, "ts", "jinc0002")
    sync.sync_incremental(rep, events, "ts", "jinc0003")
    return rep.read()


@register("sync_retry", "Y2", "SELECT * FROM events")
def sync_retry(spark, sf):
    """Each job id runs twice, as after a lost answer; ids that look like the
    same number stay distinct."""
    rep = sync.Replica(spark, work_dir(spark, "replica"), "events")
    events = io.scan(spark, sf, "events")
    early = events.where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    for src, job in ((early, "010"), (early, "010"), (events, "10"), (events, "10"), (events, "010")):
        sync.sync_incremental(rep, src, "ts", job)
    return rep.read()


@register("sync_failed_log", "Y12", """
SELECT 'jbad0001' AS job_id, 'failed' AS status, CAST(0 AS BIGINT) AS rows_processed, true AS told, count(*) AS visible
FROM events WHERE event_type <> 'error'""")
def sync_failed_log(spark, sf):
    """A sync whose source breaks while it is read: logged with its error, nothing visible of it."""
    rep = sync.Replica(spark, work_dir(spark, "replica"), "events")
    events = io.scan(spark, sf, "events")
    sync.sync_full(rep, events, "jgood001", where="event_type <> 'error'")
    broken = events.withColumn("value", F.when(F.col("event_type") == "error", F.raise_error(F.lit("source went away")))
                               .otherwise(F.col("value")))
    try:
        sync.sync_full(rep, broken, "jbad0001")
    except Exception as exc:
        if "source went away" not in str(exc):
            raise
    visible = rep.read().count()
    return (rep.log().where("job_id = 'jbad0001'")
            .select("job_id", "status", "rows_processed", F.col("error_message").contains("source went away").alias("told"),
                    F.lit(visible).cast("bigint").alias("visible")))


@register("sync_compact", "Y2", "SELECT * FROM events")
def sync_compact(spark, sf):
    """Three incremental drops (the source as of the 10th, 20th and 25th of
    January), compaction into one base, then the rest incrementally."""
    rep = sync.Replica(spark, work_dir(spark, "replica"), "events")
    events = io.scan(spark, sf, "events")
    for i, day in enumerate(("2024-01-10", "2024-01-20", "2024-01-25")):
        cut = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
        sync.sync_incremental(rep, events.where(F.col("ts") < cut), "ts", f"jcmp000{i}")
    sync.compact(rep, "jcmp0010")
    sync.sync_incremental(rep, events, "ts", "jcmp0011")
    return rep.read()


def _orders_delta(orders):
    """Modified open orders (two versions each, the later wins) and new urgent
    orders under fresh keys."""
    cols = orders.columns
    changed = orders.where(F.col("o_orderstatus") == "O")
    v1 = changed.withColumn("o_orderstatus", F.lit("X")).withColumn("_v", F.lit(1))
    v2 = (changed.withColumn("o_orderstatus", F.lit("F"))
          .withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("_v", F.lit(2)))
    new = (orders.where(F.col("o_orderpriority") == "1-URGENT")
           .withColumn("o_orderkey", F.col("o_orderkey") + 1000000000).withColumn("_v", F.lit(1)))
    return v1.unionByName(v2).unionByName(new).select(*cols, "_v")


_UPSERTED = f"""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders
UNION ALL
SELECT o_orderkey + 1000000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'"""


@register("sync_upsert", "Y3", _UPSERTED)
def sync_upsert(spark, sf):
    orders = io.scan(spark, sf, "orders")
    return sync.upsert(orders, _orders_delta(orders), ["o_orderkey"], "_v")


_VERSIONED = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 7 AS ver, 0 AS side FROM orders"""
# Versions 0..8 against the target's 0..6, so the delta is older, equal and newer;
# every ninth key is null and many rows share it.
_VERSIONED_DELTA = """
SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, o_custkey,
  o_totalprice + 1 AS o_totalprice, o_custkey % 9 AS ver, 1 AS side FROM orders WHERE o_orderstatus <> 'F'"""
_UPSERT_VERSION = f"""
SELECT o_orderkey, o_custkey, o_totalprice, ver FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ver DESC, side DESC, o_custkey DESC, o_totalprice DESC) AS rn
  FROM ({_VERSIONED} UNION ALL {_VERSIONED_DELTA})) WHERE rn = 1"""


def _versioned(spark, sf):
    Tables(spark, sf).register(["orders"])
    return spark.sql(_VERSIONED).drop("side"), spark.sql(_VERSIONED_DELTA).drop("side")


@register("sync_upsert_version", "Y3", _UPSERT_VERSION)
def sync_upsert_version(spark, sf):
    target, delta = _versioned(spark, sf)
    return sync.upsert(target, delta, ["o_orderkey"], "ver")


@register("sync_upsert_replica", "Y3", f"""
SELECT u.*, (SELECT count(*) FROM ({_UPSERT_VERSION})) AS logged_rows FROM ({_UPSERT_VERSION}) AS u""")
def sync_upsert_replica(spark, sf):
    """The same as a replica write: a full copy, then the upsert (run twice) as its next base."""
    rep = sync.Replica(spark, work_dir(spark, "replica"), "orders")
    target, delta = _versioned(spark, sf)
    sync.sync_full(rep, target, "jups0001")
    for _ in range(2):
        job = sync.sync_upsert(rep, delta, ["o_orderkey"], "jups0002", "ver")
    return rep.read().withColumn("logged_rows", F.lit(job["rows_processed"]).cast("bigint"))


# Three deltas on the versions 0..6 of the target: one key in a thousand and new keys; older and newer versions; every key of one customer in twenty.
_KEYED_BASE = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 7 AS ver FROM orders"
_KEYED_DELTAS = [
    "SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, CAST(9 AS BIGINT) AS ver FROM orders WHERE o_orderkey % 1000 = 1"
    " UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice, 0 FROM orders WHERE o_orderkey % 300 = 2",
    "SELECT o_orderkey, o_custkey, o_totalprice + 2, o_custkey % 12 FROM orders WHERE o_orderkey % 50 = 1",
    "SELECT o_orderkey, o_custkey, o_totalprice + 3, CAST(8 AS BIGINT) FROM orders WHERE o_custkey % 20 = 3"]
_KEYED = "SELECT o_orderkey, o_custkey, o_totalprice, ver FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ver DESC, step DESC) AS rn FROM ("
_KEYED += " UNION ALL ".join(f"SELECT *, {i} AS step FROM ({text})" for i, text in enumerate([_KEYED_BASE, *_KEYED_DELTAS])) + ")) WHERE rn = 1"


def _keyed(spark, sf):
    from cairn.operators.keyed import KeyedReplica
    Tables(spark, sf).register(["orders"])
    rep = KeyedReplica(spark, work_dir(spark, "keyed"), ["o_orderkey"], "orders", buckets=16)
    rep.load(spark.sql(_KEYED_BASE), "jkey0000")
    return rep, [spark.sql(text).toDF("o_orderkey", "o_custkey", "o_totalprice", "ver") for text in _KEYED_DELTAS]


@register("keyed_upsert", "Y3", _KEYED)
def keyed_upsert(spark, sf):
    """Three upserts by version on a replica in key buckets, merged on read."""
    rep, deltas = _keyed(spark, sf)
    for i, delta in enumerate(deltas):
        rep.upsert(delta, f"jkey000{i + 1}", "ver")
    return rep.read()


@register("keyed_compact", "Y3", _KEYED)
def keyed_compact(spark, sf):
    """The same with the buckets of many replaced rows rewritten between the second and the third, and all after it."""
    rep, deltas = _keyed(spark, sf)
    for i, delta in enumerate(deltas):
        rep.upsert(delta, f"jkey000{i + 1}", "ver")
        if i:
            rep.compact_buckets(f"jkey001{i}", most_replaced=0.01 if i == 1 else 0.0)
    return rep.read()


@register("keyed_written", "Y3", """
SELECT 'jkey0000' AS job_id, count(*) AS rows_written, CAST(0 AS BIGINT) AS rows_replaced FROM orders
UNION ALL SELECT 'jkey0001', count_if(o_orderkey % 1000 = 1) + count_if(o_orderkey % 300 = 2), count_if(o_orderkey % 1000 = 1) FROM orders""")
def keyed_written(spark, sf):
    """What a load and an upsert of a thousandth of the keys write: the delta's rows and the places of those they replace."""
    rep, deltas = _keyed(spark, sf)
    rep.upsert(deltas[0], "jkey0001", "ver")
    entries = rep.snapshot().done
    return spark.createDataFrame([(e["job_id"], e["rows_processed"], e["deleted"]) for e in entries],
                                 "job_id string, rows_written bigint, rows_replaced bigint")


@register("sync_snapshot", "Y4", f"""
SELECT {ORDER_COLS}, 's20240101T000000' AS snapshot FROM orders
UNION ALL
SELECT {ORDER_COLS}, 's20240201T000000' AS snapshot FROM orders WHERE o_orderstatus <> 'F'""")
def sync_snapshot(spark, sf):
    target = work_dir(spark, "snapshots")
    orders = io.scan(spark, sf, "orders")
    sync.sync_snapshot(orders, target, "2024-01-01 00:00:00")
    sync.sync_snapshot(orders, target, "2024-02-01 00:00:00", where="o_orderstatus <> 'F'")
    # A rerun of the first snapshot replaces only its own partition.
    sync.sync_snapshot(orders, target, "2024-01-01 00:00:00")
    return spark.read.parquet(target)


@register("snapshot_as_of", "Y5", "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def snapshot_as_of(spark, sf):
    target = work_dir(spark, "snapshots")
    orders = io.scan(spark, sf, "orders")
    sync.sync_snapshot(orders, target, "2024-01-01 00:00:00", where="o_orderstatus <> 'P'")
    sync.sync_snapshot(orders, target, "2024-02-01 00:00:00", where="o_orderstatus <> 'F'")
    sync.sync_snapshot(orders, target, "2024-03-01 00:00:00")
    return sync.snapshot_as_of(spark, target, "2024-02-15 00:00:00")


@register("conform_rows", "Y6", """
SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
  CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer""")
def conform_rows(spark, sf):
    t = Tables(spark, sf)
    cols = t["source_columns"].where(F.col("table_name") == "customer")
    return sync.conform_schema(t["customer"], cols)[0]


@register("conform_violations", "Y6", """
SELECT * FROM (VALUES
  ('c_custkey', 'cast_failed', 0), ('c_custkey', 'null_in_not_null', (SELECT count(*) FROM customer WHERE c_custkey IS NULL)),
  ('c_name', 'cast_failed', 0), ('c_name', 'null_in_not_null', (SELECT count(*) FROM customer WHERE c_name IS NULL)),
  ('c_name', 'too_long', (SELECT count(*) FROM customer WHERE length(c_name) > 18)),
  ('c_nationkey', 'cast_failed', 0), ('c_nationkey', 'null_in_not_null', (SELECT count(*) FROM customer WHERE c_nationkey IS NULL)),
  ('c_acctbal', 'cast_failed', 0),
  ('c_mktsegment', 'cast_failed', 0), ('c_mktsegment', 'too_long', (SELECT count(*) FROM customer WHERE length(c_mktsegment) > 9))
) AS v(column_name, check_name, violations)""")
def conform_violations(spark, sf):
    t = Tables(spark, sf)
    cols = t["source_columns"].where(F.col("table_name") == "customer")
    return sync.conform_schema(t["customer"], cols)[1]


#: Orders with values that don't fit their declared types: prices that are no numbers, long and null priorities, null keys.
_MISFIT = """
SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_totalprice AS STRING) END AS o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders"""
_MISFIT_COLUMNS = [("orders", 1, "o_orderkey", "NUMBER(38,0)", "Y"), ("orders", 2, "o_totalprice", "FLOAT", "Y"),
                   ("orders", 3, "o_orderpriority", "VARCHAR(10)", "N")]


def _misfits(spark, sf):
    Tables(spark, sf).register(["orders"])
    columns = spark.createDataFrame(_MISFIT_COLUMNS, "table_name string, ordinal int, name string, declared_type string, nullable string")
    return spark.sql(_MISFIT), columns


_MISFIT_COUNTS = """
SELECT 'o_orderkey' AS column_name, 'cast_failed' AS check_name, CAST(0 AS BIGINT) AS violations
UNION ALL SELECT 'o_totalprice', 'cast_failed', (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0)
UNION ALL SELECT 'o_orderpriority', 'cast_failed', 0
UNION ALL SELECT 'o_orderpriority', 'null_in_not_null', (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0)
UNION ALL SELECT 'o_orderpriority', 'too_long', (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0 AND length(o_orderpriority) > 10)"""


@register("conform_misfits", "Y6", _MISFIT_COUNTS)
def conform_misfits(spark, sf):
    """Checks that fail: values that don't cast, too long ones, and nulls where none may be."""
    return sync.conform_schema(*_misfits(spark, sf))[1]


@register("sync_misfits", "Y12", """
SELECT 'jfit0001' AS job_id, 'failed' AS status, CAST(0 AS BIGINT) AS visible, count_if(o_orderkey % 7 = 0) AS cast_failed,
  count_if(o_orderkey % 5 = 0) AS nulls FROM orders
UNION ALL SELECT 'jfit0002', 'completed', count_if(o_orderkey % 5 <> 0), count_if(o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0), NULL FROM orders""")
def sync_misfits(spark, sf):
    """The same source synced to its declared types: nulls in a NOT NULL column fail the job, values that don't cast are logged."""
    src, columns = _misfits(spark, sf)
    rep = sync.Replica(spark, work_dir(spark, "replica"), "orders")
    seen = {}
    for job, where in (("jfit0001", None), ("jfit0002", "o_orderpriority IS NOT NULL")):
        sync.sync_full(rep, src, job, where=where, columns=columns)
        seen[job] = rep.read().count()
    visible = spark.createDataFrame(list(seen.items()), "job_id string, visible bigint")
    return rep.log().join(visible, "job_id").select(
        "job_id", "status", "visible", F.col("violations")["o_totalprice.cast_failed"].alias("cast_failed"),
        F.col("violations")["o_orderpriority.null_in_not_null"].alias("nulls"))


@register("sync_two_writers", "Y2", "SELECT * FROM events")
def sync_two_writers(spark, sf):
    """Two writers of one replica: the second copies up to the 20th while the first works, so the first's rows would
    overlap; it loses the next number and starts again from the new watermark."""
    root = work_dir(spark, "replica")
    first, second = sync.Replica(spark, root, "events"), sync.Replica(spark, root, "events")
    events = io.scan(spark, sf, "events")

    def before(day):
        return events.where(F.col("ts") < F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz"))

    sync.sync_incremental(first, before("10"), "ts", "jtwo0001")
    work = [lambda: sync.sync_incremental(second, before("20"), "ts", "jtwo0002")]

    def plan(seen):
        if work:
            work.pop()()
        after = F.lit(seen.watermark()).cast("timestamp_ntz")
        return sync.Batch(events.where(F.col("ts") > after), "incremental", watermark_col="ts")

    first.run("jtwo0003", plan)
    return second.read()


@register("describe_columns", "Y7", """
SELECT table_name, ordinal, name AS column_name, trim(regexp_extract(declared_type, '^([^(]+)', 1)) AS base_type,
  CASE WHEN trim(regexp_extract(declared_type, '^([^(]+)', 1)) IN ('VARCHAR', 'CHAR', 'TEXT') AND declared_type LIKE '%(%'
       THEN CAST(regexp_extract(declared_type, '\\((\\d+)', 1) AS BIGINT) END AS max_length,
  CASE WHEN trim(regexp_extract(declared_type, '^([^(]+)', 1)) IN ('NUMBER', 'DECIMAL') AND declared_type LIKE '%(%'
       THEN CAST(regexp_extract(declared_type, '\\((\\d+)', 1) AS INTEGER) END AS precision,
  CASE WHEN trim(regexp_extract(declared_type, '^([^(]+)', 1)) IN ('NUMBER', 'DECIMAL') AND declared_type LIKE '%(%'
       THEN coalesce(CAST(nullif(regexp_extract(declared_type, ',\\s*(\\d+)\\s*\\)', 1), '') AS INTEGER), 0) END AS scale,
  CASE WHEN nullable = 'Y' THEN 'YES' ELSE 'NO' END AS is_nullable,
  CASE WHEN trim(regexp_extract(declared_type, '^([^(]+)', 1)) IN ('VARCHAR', 'CHAR', 'TEXT') AND declared_type LIKE '%(%'
         THEN 'VARCHAR(' || regexp_extract(declared_type, '\\((\\d+)', 1) || ')'
       WHEN trim(regexp_extract(declared_type, '^([^(]+)', 1)) IN ('NUMBER', 'FLOAT') THEN 'DOUBLE'
       WHEN trim(regexp_extract(declared_type, '^([^(]+)', 1)) IN ('BOOLEAN', 'DATE') THEN trim(regexp_extract(declared_type, '^([^(]+)', 1))
       WHEN trim(regexp_extract(declared_type, '^([^(]+)', 1)) LIKE 'TIMESTAMP_%' THEN 'TIMESTAMP'
       ELSE 'VARCHAR' END AS replica_type
FROM (SELECT * FROM source_columns UNION ALL SELECT * FROM declared_columns) AS c""",
          fixtures=["source_columns", "declared_columns"])
def describe_columns(spark, sf):
    t = Tables(spark, sf)
    return sync.describe_columns(t["source_columns"].unionByName(t["declared_columns"]))


@register("high_watermark", "Y8", "SELECT max(ts) AS high_watermark FROM events")
def high_watermark(spark, sf):
    return sync.high_watermark(io.scan(spark, sf, "events"), "ts")


_LAST_WM = """
SELECT table_id, last_value FROM (
  SELECT table_id, last_value,
    row_number() OVER (PARTITION BY table_id ORDER BY completed_at DESC, job_id DESC) AS rn
  FROM sync_jobs WHERE status = 'completed' AND last_value IS NOT NULL) WHERE rn = 1"""


@register("last_watermark", "Y9", _LAST_WM, fixtures=["sync_jobs"])
def last_watermark(spark, sf):
    return sync.last_watermark(Tables(spark, sf)["sync_jobs"])


@register("table_stats", "Y10", "SELECT count(*) AS row_count FROM lineitem")
def table_stats(spark, sf):
    st = sync.table_stats(spark, f"{sf}/lineitem.parquet")
    return st.select("row_count")


def _reconcile_oracle() -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    parts = ["SELECT 'row_count' AS check_name, '*' AS column_name, (SELECT count(*) FROM orders) AS source_value,"
             " (SELECT count(*) FROM upserted) AS replica_value"]
    for c in cols:
        parts.append(f"SELECT 'null_count', '{c}', (SELECT count(*) FROM orders WHERE {c} IS NULL),"
                     f" (SELECT count(*) FROM upserted WHERE {c} IS NULL)")
    parts.append("SELECT 'only_in_source', '*', 0, 0")
    parts.append("SELECT 'only_in_replica', '*', 0, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')")
    parts.append("SELECT 'changed', '*', 0, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')")
    for c in cols:
        parts.append(f"SELECT 'type_mismatch', '{c}', 0, 0")
    body = "\nUNION ALL\n".join(parts)
    return (f"WITH upserted AS ({_UPSERTED}),\nchecks AS ({body})\n"
            "SELECT check_name, column_name, CAST(source_value AS BIGINT) AS source_value,"
            " CAST(replica_value AS BIGINT) AS replica_value, source_value = replica_value AS ok FROM checks")


@register("reconcile", "Y11", _reconcile_oracle())
def reconcile(spark, sf):
    orders = io.scan(spark, sf, "orders")
    replica = sync.upsert(orders, _orders_delta(orders), ["o_orderkey"], "_v")
    return sync.reconcile(orders, replica, ["o_orderkey"])


@register("reconcile_differences", "Y11", """
SELECT 'changed' AS check_name, '*' AS column_name, CAST(0 AS BIGINT) AS source_value, count(*) AS replica_value,
  count(*) = 0 AS ok FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey IS NOT NULL
UNION ALL SELECT 'missing_column', 'o_orderpriority', 1, 0, false
UNION ALL SELECT 'missing_column', 'extra', 0, 1, false""")
def reconcile_differences(spark, sf):
    """Values swapped between two nullable columns of one type, and a column
    that only one side has: the checks that fail."""
    orders = io.scan(spark, sf, "orders")
    odd = F.col("o_orderkey") % 50 == 0
    src = orders.withColumn("a", F.when(odd, F.col("o_orderstatus"))).withColumn("b", F.lit(None).cast("string"))
    # As many rows hold their value in b from the start, so null counts agree column by column.
    src = src.withColumn("b", F.when(F.col("o_orderkey") % 50 == 1, F.lit("x")))
    tgt = (src.withColumn("a2", F.when(odd, F.col("b")).otherwise(F.col("a")))
              .withColumn("b", F.when(odd, F.col("a")).otherwise(F.col("b")))
              .withColumn("a", F.col("a2")).drop("a2", "o_orderpriority").withColumn("extra", F.lit(1)))
    found = sync.reconcile(src, tgt, ["o_orderkey"])
    return found.where("not ok and check_name <> 'null_count'")


# Keys of three orders each on both sides; the replica lacks some, has others twice, and some with other prices or no status.
_REC_SOURCE = "SELECT o_orderkey % 5000 AS k, o_orderstatus AS status, o_totalprice AS price FROM orders"
_REC_REPLICA = """
SELECT o_orderkey % 5000 AS k, CASE WHEN o_orderkey % 301 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 5000 <> 11
UNION ALL SELECT o_orderkey % 5000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 211 = 3
UNION ALL SELECT o_orderkey + 70000000, 'new', o_totalprice FROM orders WHERE o_orderkey % 401 = 5"""


@register("reconcile_rows", "Y11", f"""
WITH s AS ({_REC_SOURCE}), t AS ({_REC_REPLICA}),
d AS (SELECT *, 'source' AS side FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t)
      UNION ALL SELECT *, 'replica' FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s))
SELECT k, status, price, side, CASE WHEN k IN (SELECT k FROM s) AND k IN (SELECT k FROM t) THEN 'changed' ELSE 'missing' END AS kind,
  count(*) AS copies FROM d GROUP BY ALL""")
def reconcile_rows(spark, sf):
    """The rows in which a source and its replica differ, both ways, keys repeated on both sides."""
    Tables(spark, sf).register(["orders"])
    return sync.reconcile_rows(spark.sql(_REC_SOURCE), spark.sql(_REC_REPLICA), ["k"])


@register("sync_job_stats", "Y12", """
SELECT 'jstats001' AS job_id, 'orders' AS table_name, 'full' AS strategy, 'completed' AS status,
  count(*) AS rows_processed, count(*) AS total_rows FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def sync_job_stats(spark, sf):
    rep = sync.Replica(spark, work_dir(spark, "replica"), "orders")
    src = io.scan(spark, sf, "orders")
    where = "o_orderdate >= TIMESTAMP_NTZ '1998-01-01'"
    sync.sync_full(rep, src, "jstats001", where=where, check_total=True)
    return rep.log().select("job_id", "table_name", "strategy", "status", "rows_processed", "total_rows")


@register("resume_plan", "Y13", f"""
WITH latest AS (
  SELECT table_id, job_id AS last_job_id, strategy, status AS last_status FROM (
    SELECT *, row_number() OVER (PARTITION BY table_id
      ORDER BY coalesce(started_at, TIMESTAMP '0001-01-01') DESC, job_id DESC) AS rn FROM sync_jobs) WHERE rn = 1),
wm AS ({_LAST_WM})
SELECT a.table_id, a.schema_name, a.table_name, l.last_job_id, l.strategy, l.last_status, w.last_value
FROM allowed_tables a LEFT JOIN latest l ON a.table_id = l.table_id LEFT JOIN wm w ON a.table_id = w.table_id
WHERE a.status = 'active' AND (l.last_status IS NULL OR l.last_status <> 'completed')""",
          fixtures=["allowed_tables", "sync_jobs"])
def resume_plan(spark, sf):
    t = Tables(spark, sf)
    return sync.resume_plan(t["allowed_tables"], t["sync_jobs"]).select(
        "table_id", "schema_name", "table_name", "last_job_id", "strategy", "last_status", "last_value")


def _batched_events(t):
    """events as a replica whose batch column names the sync job that wrote
    each run of ten consecutive events."""
    return t["events"].withColumn(
        "batch", F.concat(F.lit("j"), F.lpad((F.col("event_id") - F.col("event_id") % 10 + 5).cast("string"), 8, "0")))


_BATCH = "concat('j', lpad(CAST(event_id - event_id % 10 + 5 AS VARCHAR), 8, '0'))"


@register("committed_only", "Y14", f"""
SELECT e.*, {_BATCH} AS batch FROM events e
WHERE EXISTS (SELECT 1 FROM sync_jobs j WHERE j.job_id = {_BATCH} AND j.status = 'completed')""",
          fixtures=["sync_jobs"])
def committed_only(spark, sf):
    t = Tables(spark, sf)
    return sync.committed_only(_batched_events(t), t["sync_jobs"])[0]


@register("orphaned_rows", "Y14", f"""
SELECT e.*, {_BATCH} AS batch FROM events e
WHERE NOT EXISTS (SELECT 1 FROM sync_jobs j WHERE j.job_id = {_BATCH} AND j.status = 'completed')""",
          fixtures=["sync_jobs"])
def orphaned_rows(spark, sf):
    t = Tables(spark, sf)
    return sync.committed_only(_batched_events(t), t["sync_jobs"])[1]
