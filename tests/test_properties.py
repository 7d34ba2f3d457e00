
import datetime as dt
import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import artifacts as art
from cairn.operators import joblog, profile, sqljobs, sync
from cairn.plans.fixtures import ARTIFACT_CLOCK, JOB_CLOCK
from cairn.session import work_dir
from cairn.sources import io
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- replication -----------------------------------------------------------------

def test_full_sync_twice_equals_once_and_empty_source_empties(spark):
    orders = io.scan(spark, SF_SMALL, "orders")
    rep = sync.Replica(spark, work_dir(spark, "t-full"), "orders")
    sync.sync_full(rep, orders, "jf1")
    once = _rows(rep.read())
    sync.sync_full(rep, orders, "jf2")
    assert _rows(rep.read()) == once == _rows(orders)
    job = sync.sync_full(rep, orders.where(F.lit(False)), "jf3")
    assert job["rows_processed"] == 0 and rep.read().count() == 0


def test_incremental_two_steps_equals_full_and_keeps_watermark(spark):
    ev = io.scan(spark, SF_SMALL, "events")
    rep = sync.Replica(spark, work_dir(spark, "t-inc"), "events")
    j1 = sync.sync_incremental(rep, ev.where("event_id < 300"), "event_id", "ji1")
    assert j1["last_value"] == "299"
    j2 = sync.sync_incremental(rep, ev, "event_id", "ji2")
    j3 = sync.sync_incremental(rep, ev, "event_id", "ji3")  # empty delta
    assert j3["rows_processed"] == 0 and j3["last_value"] is None
    assert sync.last_logged_watermark(rep) == j2["last_value"]
    assert _rows(rep.read()) == _rows(ev)


def test_unlogged_batch_is_invisible(spark):
    ev = io.scan(spark, SF_SMALL, "events")
    rep = sync.Replica(spark, work_dir(spark, "t-orphan"), "events")
    sync.sync_full(rep, ev, "jo1")
    # A run that wrote data but died before logging.
    ev.write.mode("overwrite").parquet(f"{rep.data_path}/batch=jo2")
    assert rep.read().count() == ev.count()


def test_done_job_ids_are_not_run_again_and_stay_distinct(spark):
    ev = io.scan(spark, SF_SMALL, "events")
    rep = sync.Replica(spark, work_dir(spark, "t-retry"), "events")
    assert rep.read().count() == 0
    with pytest.raises(ValueError):
        sync.compact(rep, "jc0")
    sync.sync_full(rep, ev.limit(100), "010", watermark_col="event_id")
    sync.sync_full(rep, ev.limit(5), "10", watermark_col="event_id")
    assert rep.read().count() == 5
    sync.sync_full(rep, ev, "010", watermark_col="event_id")
    assert rep.read().count() == 5
    inc = sync.Replica(spark, work_dir(spark, "t-retry2"), "events")
    for _ in range(2):
        job = sync.sync_incremental(inc, ev, "event_id", "j1")
        assert job["rows_processed"] == ev.count() == inc.read().count()


def test_failed_run_is_logged_whole_and_retried(spark):
    ev = io.scan(spark, SF_SMALL, "events")
    rep = sync.Replica(spark, work_dir(spark, "t-fail"), "events")
    message = "bad row " + "x" * 3000
    broken = ev.withColumn("value", F.when(F.col("event_id") == 7, F.raise_error(F.lit(message))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        sync.sync_incremental(rep, broken, "event_id", "j1")
    row = rep.log().first()
    assert row.status == "failed" and message in row.error_message and rep.read().count() == 0
    sync.sync_incremental(rep, ev, "event_id", "j1")
    assert _rows(rep.read()) == _rows(ev)


def test_schema_drift_is_read_or_refused(spark):
    ev = io.scan(spark, SF_SMALL, "events")
    rep = sync.Replica(spark, work_dir(spark, "t-drift"), "events")
    sync.sync_full(rep, ev.where("event_id < 500"), "j1", watermark_col="event_id")
    sync.sync_incremental(rep, ev.withColumn("added", F.lit("new")), "event_id", "j2")
    got = rep.read()
    assert got.columns == [*ev.columns, "added"] and got.where("added is null").count() == ev.where("event_id < 500").count()
    more = ev.withColumn("event_id", F.col("event_id") + 100000)
    with pytest.raises(ValueError):
        sync.sync_incremental(rep, more.withColumn("value", F.col("value").cast("string")), "event_id", "j3")
    sync.sync_full(rep, ev.select("event_id", "value"), "j4")
    assert rep.read().columns == ["event_id", "value"]


def test_vacuum_removes_only_superseded_batches(spark):
    ev = io.scan(spark, SF_SMALL, "events")
    rep = sync.Replica(spark, work_dir(spark, "t-vacuum"), "events")
    for i in range(3):
        sync.sync_full(rep, ev, f"j{i}")
    assert rep.vacuum(grace_hours=24) == 0
    assert rep.vacuum(grace_hours=-1) == 2
    assert _rows(rep.read()) == _rows(ev)


def test_conform_on_the_way_into_a_replica(spark, tables):
    cols = tables["source_columns"].where("table_name = 'customer'")
    rep = sync.Replica(spark, work_dir(spark, "t-conform"), "customer")
    sync.sync_full(rep, tables["customer"], "j1", columns=cols)
    assert dict(rep.read().dtypes)["c_custkey"] == "double"


def test_quotes_in_column_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "k int, `it's` string, `a``b` double")
    assert all(r.ok for r in sync.reconcile(df, df, ["k"]).collect())
    cols = spark.createDataFrame([("t", 1, "it's", "VARCHAR(1)", "N")], "table_name string, ordinal int, name string, declared_type string, nullable string")
    assert {r.violations for r in sync.conform_schema(df, cols)[1].collect()} == {0}


def test_declared_types_with_blanks(spark):
    d = spark.createDataFrame([("t", 1, "a", "NUMBER (38, 0)", "Y"), ("t", 2, "b", "VARCHAR (10)", "Y")],
                              "table_name string, ordinal int, name string, declared_type string, nullable string")
    got = {r.column_name: (r.base_type, r.precision, r.scale, r.replica_type) for r in sync.describe_columns(d).collect()}
    assert got == {"a": ("NUMBER", 38, 0, "DOUBLE"), "b": ("VARCHAR", None, None, "VARCHAR(10)")}


def test_snapshot_rerun_changes_nothing(spark):
    orders = io.scan(spark, SF_SMALL, "orders")
    target = work_dir(spark, "t-snap")
    sync.sync_snapshot(orders, target, "2024-01-01 00:00:00")
    sync.sync_snapshot(orders.where("o_orderstatus = 'F'"), target, "2024-02-01 00:00:00")
    before = _rows(spark.read.parquet(target))
    sync.sync_snapshot(orders, target, "2024-01-01 00:00:00")
    assert _rows(spark.read.parquet(target)) == before
    assert sync.snapshot_as_of(spark, target, "2023-12-31 00:00:00").count() == 0
    assert sync.snapshot_as_of(spark, target, "2024-01-20 00:00:00").count() == orders.count()


def test_upsert_latest_version_wins(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    d = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, v string, ver int")
    assert _rows(sync.upsert(t, d, ["k"], "ver")) == [(1, "y"), (2, "b"), (3, "z")]


def test_conform_exact_and_violations(spark):
    df = spark.createDataFrame(
        [(9007199254740993, "abcdefghij", None), (1, "ok", 5)], "a bigint, b string, c int")
    cols = spark.createDataFrame(
        [("x", 1, "a", "NUMBER(38,0)", "N"), ("x", 2, "b", "VARCHAR(5)", "Y"), ("x", 3, "c", "NUMBER(5)", "N")],
        "table_name string, ordinal int, name string, declared_type string, nullable string")
    rows, viol = sync.conform_schema(df, cols)
    v = {(r.column_name, r.check_name): r.violations for r in viol.collect()}
    assert v[("b", "too_long")] == 1 and v[("c", "null_in_not_null")] == 1
    assert dict(rows.dtypes)["a"] == "double"
    exact, _ = sync.conform_schema(df, cols, exact=True)
    assert dict(exact.dtypes)["a"] == "decimal(38,0)"
    assert int(exact.where("b = 'abcdefghij'").first()["a"]) == 9007199254740993


def test_reconcile_identical_tables_all_ok(spark):
    orders = io.scan(spark, SF_SMALL, "orders")
    assert all(r.ok for r in sync.reconcile(orders, orders, ["o_orderkey"]).collect())


def test_committed_and_orphaned_partition_everything(spark, tables):
    ev = tables["events"].withColumn("batch", F.concat(F.lit("j"), F.lpad((F.col("event_id") - F.col("event_id") % 10 + 5).cast("string"), 8, "0")))
    kept, orphaned = sync.committed_only(ev, tables["sync_jobs"])
    assert kept.count() + orphaned.count() == ev.count()
    assert kept.join(orphaned, "event_id").count() == 0


# -- profiling -------------------------------------------------------------------

def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([np.full(3000, 5.0), rng.normal(0, 10, 6000)])
    df = spark.createDataFrame([(float(x),) for x in vals], "x double")
    p = profile.profile_numeric(df).first()
    q = np.quantile(vals, [0.25, 0.5, 0.75])
    assert math.isclose(p.p25, q[0], rel_tol=1e-12) and math.isclose(p.p50, q[1], rel_tol=1e-12)
    assert math.isclose(p.p75, q[2], rel_tol=1e-12)
    assert math.isclose(p.std, float(np.std(vals, ddof=1)), rel_tol=1e-9)


def test_profile_edge_rows(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (float("nan"), None, "b")], "x double, y double, s string")
    p = {r.column_name: r for r in profile.profile_numeric(df).collect()}
    assert p["x"]["count"] == 1 and p["x"].std is None and p["x"].p50 == 1.0
    assert p["y"]["count"] == 0 and p["y"].p50 is None
    nulls = {r.column_name: r.null_count for r in profile.null_counts(df).collect()}
    assert nulls == {"x": 1, "y": 2, "s": 0}
    top = profile.profile_text(df.select("s")).first()
    assert (top.top, top.freq, top.unique) == ("a", 1, 2)  # tie: smallest value


def test_sample_fractions_zero_and_one(spark):
    ev = io.scan(spark, SF_SMALL, "events")
    assert profile.sample_hash(ev, ["event_id"], 0.0).count() == 0
    assert profile.sample_hash(ev, ["event_id"], 1.0).count() == ev.count()
    assert profile.sample_random(ev, 1.0).count() == ev.count()
    with pytest.raises(ValueError):
        profile.sample_random(ev, 1.5)


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    h = {r.bin: r["count"] for r in profile.histogram(df, "x", 2).collect()}
    assert h == {1: 1, 2: 2}


# -- job log ---------------------------------------------------------------------

def test_retention_idempotent_and_keeps_unfinished(tables):
    jobs = tables["sync_jobs"]
    once = joblog.retention_delete(jobs, JOB_CLOCK)
    assert _rows(joblog.retention_delete(once, JOB_CLOCK)) == _rows(once)
    assert once.where("completed_at IS NULL").count() == jobs.where("completed_at IS NULL").count()


def test_retention_cutoff_is_strict(spark):
    jobs = spark.createDataFrame(
        [("a", "completed", dt.datetime(2024, 1, 27, 0, 0)), ("b", "completed", dt.datetime(2024, 1, 26, 23, 59))],
        "job_id string, status string, completed_at timestamp_ntz")
    assert [r.job_id for r in joblog.retention_delete(jobs, JOB_CLOCK).collect()] == ["a"]


# -- artifacts -------------------------------------------------------------------

def test_strict_base64(spark):
    up = spark.createDataFrame(
        [(1, "n", "data", "json", "YmFy", None), (2, "n", "data", "json", "YmF", None),
         (3, "n", "data", "json", "*bad", None), (4, "n", "data", "json", "", 3),
         (5, None, "data", "json", "YmFy", None), (6, "n", "data", "json", None, None),
         (7, "n", "data", "json", "YWJ\n", None), (8, "n", "data", "json", "A==\n", None)],
        "upload_id bigint, name string, type string, format string, content string, expiry_days int"
    ).withColumn("swarm_token", F.lit("o"))
    acc, _, rej = art.ingest(up, ARTIFACT_CLOCK)
    assert {r.artifact_id: r.size_bytes for r in acc.collect()} == {"a00000001": 3, "a00000004": 0}
    assert {r.upload_id: r.reason for r in rej.collect()} == {
        2: "invalid base64", 3: "invalid base64", 5: "invalid name", 6: "invalid base64",
        7: "invalid base64", 8: "invalid base64"}


def test_touch_never_shortens_and_purge_splits(tables):
    a = tables["artifacts"]
    touched = art.touch(a, tables["artifact_access"])
    j = a.alias("o").join(touched.alias("n"), "artifact_id")
    assert j.where(F.col("n.expires_at") < F.col("o.expires_at")).count() == 0
    live, _, expired = art.purge(a, tables["artifact_tags"], ARTIFACT_CLOCK)
    assert live.count() + expired.count() == a.count()


def test_patch_rules(spark):
    a = spark.createDataFrame(
        [("a1", "n1", "m1", dt.datetime(2024, 1, 20), "own", "artifacts/a1")],
        "artifact_id string, name string, metadata string, expires_at timestamp_ntz, swarm_token string, "
        "storage_path string")
    p = spark.createDataFrame([("a1", "own", None, None, None, [])],
                              "artifact_id string, swarm_token string, name string, metadata string, "
                              "expiry_days int, tags array<string>")
    assert _rows(art.update(a, p, ARTIFACT_CLOCK)) == _rows(a)  # all-null patch keeps everything
    tags = spark.createDataFrame([("a1", "x")], "artifact_id string, tag string")
    assert art.replace_tags(tags, p, a).count() == 0  # empty list clears
    wrong = p.withColumn("swarm_token", F.lit("other"))
    assert art.replace_tags(tags, wrong, a).count() == 1  # wrong owner: no-op
    assert art.delete(a, tags, wrong)[2].count() == 0


def test_patches_apply_in_order_and_bad_ones_not_at_all(spark):
    a = spark.createDataFrame(
        [("a1", "n1", "m1", dt.datetime(2024, 1, 20), "own")],
        "artifact_id string, name string, metadata string, expires_at timestamp_ntz, swarm_token string")
    p = spark.createDataFrame(
        [("a1", 1, "own", "first", "meta", 3, ["x"]), ("a1", 2, "own", "second", None, None, None),
         ("a1", 3, "own", "bad", "bad", -5, ["bad"]), ("a1", 4, "other", "other", None, 9, [])],
        "artifact_id string, patch_seq int, swarm_token string, name string, metadata string, expiry_days int, tags array<string>")
    rows = art.update(a, p, "2024-01-15 00:00:00").collect()
    assert [(r.name, r.metadata, r.expires_at) for r in rows] == [("second", "meta", dt.datetime(2024, 1, 18))]
    tags = spark.createDataFrame([("a1", "old")], "artifact_id string, tag string")
    assert _rows(art.replace_tags(tags, p, a)) == [("a1", "x")]


def test_only_the_owner_touches(spark):
    a = spark.createDataFrame([("a1", dt.datetime(2024, 1, 2), "own")], "artifact_id string, expires_at timestamp_ntz, swarm_token string")
    acc = spark.createDataFrame([("a1", dt.datetime(2024, 1, 5), "other")], "artifact_id string, accessed_at timestamp_ntz, swarm_token string")
    assert art.touch(a, acc).first().expires_at == dt.datetime(2024, 1, 2)
    assert art.touch(a, acc.withColumn("swarm_token", F.lit("own"))).first().expires_at == dt.datetime(2024, 1, 15)


def test_failed_query_job_keeps_its_whole_error(spark):
    message = "m" * 3000
    spark.range(3).createOrReplaceTempView("three")
    job = sqljobs.run_query_job(spark, "qlong", f"SELECT raise_error('{message}') AS x FROM three", "json",
                                work_dir(spark, "t-qlong")).first()
    assert job.status == "failed" and message in job.error


# -- streams ---------------------------------------------------------------------

def test_stream_restart_takes_only_new_files(spark):
    from cairn.streaming import streams
    ev = io.scan(spark, SF_SMALL, "events")
    root = work_dir(spark, "t-w1")
    ev.where("event_id < 100").write.mode("append").parquet(f"{root}/src")
    streams.stream_incremental(spark, f"{root}/src", ev.schema, f"{root}/out", f"{root}/ck")
    streams.stream_incremental(spark, f"{root}/src", ev.schema, f"{root}/out", f"{root}/ck")
    assert streams.read_stream_replica(spark, f"{root}/out").count() == 100
    ev.where("event_id >= 100").write.mode("append").parquet(f"{root}/src")
    streams.stream_incremental(spark, f"{root}/src", ev.schema, f"{root}/out", f"{root}/ck")
    assert _rows(streams.read_stream_replica(spark, f"{root}/out")) == _rows(ev)


def test_reconcile_with_repeated_keys_counts_rows_not_pairs(spark):
    li = io.scan(spark, SF_SMALL, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]  # not unique
    r = {x.check_name: x for x in sync.reconcile(li, li, keys).collect() if x.column_name == "*"}
    assert all(x.ok for x in r.values())
    missing = li.where("l_orderkey % 7 = 0")
    r = {x.check_name: x.replica_value for x in
         sync.reconcile(li, li.exceptAll(missing), keys).collect() if x.column_name == "*"}
    fully_gone = li.join(missing.select(*keys).distinct(), keys, "left_semi").count()
    assert r["only_in_source"] == fully_gone and r["only_in_replica"] == 0


def test_policies_drop_and_mask(spark, tables):
    from cairn.operators import governance
    c = tables["customer"]
    masked = governance.mask_columns(c, tables["column_policies"], "customer")
    assert "c_acctbal" not in masked.columns
    row = masked.where(F.length("c_name") > 4).first()
    assert row.c_name.startswith("*") and len(row.c_custkey) == 64
    with pytest.raises(ValueError):
        bad = spark.createDataFrame([("customer", "c_name", "explode")], "table_name string, column_name string, action string")
        governance.mask_columns(c, bad, "customer")


def test_catalog_fold_rules(spark):
    from cairn.operators import catalog
    T = dt.datetime
    acts = spark.createDataFrame([
        (1, "s", "x", "remove", T(2024, 1, 1)), (2, "s", "x", "add", T(2024, 1, 2)),
        (3, "s", "x", "add", T(2024, 1, 3)), (4, "s", "x", "remove", T(2024, 1, 4)),
        (5, "s", "x", "add", T(2024, 1, 5)), (6, "s", "x", "add", T(2024, 1, 6)),
        (7, "s", "y", "add", T(2024, 1, 1)), (8, "s", "y", "remove", T(2024, 1, 2)),
        (9, "s", "z", "add", T(2024, 1, 1)), (10, "s", "z", "remove", T(2024, 1, 2)),
    ], "action_id bigint, schema_name string, table_name string, action string, ts timestamp_ntz")
    src = spark.createDataFrame([("s", "x"), ("s", "z")], "schema_name string, table_name string")
    state, err = catalog.catalog_state(acts, src)
    st = {r.table_name: (r.table_id, r.status, r.created_at) for r in state.collect()}
    assert st == {"x": ("t2", "active", T(2024, 1, 5)), "z": ("t9", "inactive", T(2024, 1, 1))}
    errs = {r.action_id: r.error for r in err.collect()}
    assert errs == {1: "table not in catalog", 7: "table not found in source", 8: "table not in catalog"}


def test_stream_target_of_another_checkpoint_is_refused(spark):
    from cairn.streaming import streams
    ev = io.scan(spark, SF_SMALL, "events")
    root = work_dir(spark, "t-two-ck")
    ev.limit(10).write.parquet(f"{root}/a")
    ev.limit(3).write.parquet(f"{root}/b")
    streams.stream_incremental(spark, f"{root}/a", ev.schema, f"{root}/out", f"{root}/ck1")
    with pytest.raises(ValueError):
        streams.stream_incremental(spark, f"{root}/b", ev.schema, f"{root}/out", f"{root}/ck2")
    assert streams.read_stream_replica(spark, f"{root}/out").count() == 10


def test_stream_window_drops_late_rows(spark):
    from cairn.streaming import streams
    T = dt.datetime
    schema = "task_id string, worker string, queue string, state string, status string, name string, time_start timestamp_ntz"
    root = work_dir(spark, "t-w2")
    first = [("a", "w", "sync", "active", "SUCCESS", "n", T(2024, 1, 1, 5)),
             ("b", "w", None, "active", "SUCCESS", "n", T(2024, 1, 3, 5))]
    spark.createDataFrame(first, schema).write.mode("append").parquet(f"{root}/src")
    streams.stream_queue_stats(spark, f"{root}/src", schema, f"{root}/out", f"{root}/ck")
    late = [("c", "w", "sync", "active", "SUCCESS", "n", T(2024, 1, 1, 6)),   # behind the watermark
            ("d", "w", "sync", "active", "SUCCESS", "n", T(2024, 1, 5, 5))]
    spark.createDataFrame(late, schema).write.mode("append").parquet(f"{root}/src")
    streams.stream_queue_stats(spark, f"{root}/src", schema, f"{root}/out", f"{root}/ck")
    out = {(r.window_start.day, r.queue): r.tasks for r in spark.read.parquet(f"{root}/out").collect()}
    assert out == {(1, "sync"): 1, (3, "other"): 1}   # day 5 is still open


def test_stream_stale_job_emitted_after_watermark(spark):
    from cairn.streaming import streams
    T = dt.datetime
    root = work_dir(spark, "t-w3")
    starts = spark.createDataFrame([("j1", T(2024, 1, 1, 0)), ("j2", T(2024, 1, 1, 0)), ("j3", T(2024, 1, 2, 0))],
                                   "job_id string, started_at timestamp_ntz")
    ends = spark.createDataFrame([("j1", T(2024, 1, 1, 0, 30)), ("j2", T(2024, 1, 1, 3)), ("j3", T(2024, 1, 2, 5))],
                                 "job_id string, completed_at timestamp_ntz")
    starts.write.parquet(f"{root}/s")
    ends.write.parquet(f"{root}/e")
    streams.stream_stale_jobs(spark, f"{root}/s", f"{root}/e", starts.schema, ends.schema, f"{root}/out", f"{root}/ck")
    got = sorted(r.job_id for r in spark.read.parquet(f"{root}/out").collect())
    assert got == ["j2"]   # j1 ended in time; j3 waits for the watermark


def test_approx_quartiles_close_to_exact(spark):
    li = io.scan(spark, SF_SMALL, "lineitem").select("l_quantity", "l_extendedprice")
    ex = {r.column_name: r for r in profile.profile_numeric(li).collect()}
    ap = {r.column_name: r for r in profile.profile_numeric(li, approx=True).collect()}
    for c in ex:
        assert ex[c]["count"] == ap[c]["count"] and ex[c].mean == ap[c].mean
        span = ex[c].max - ex[c].min
        assert abs(ex[c].p50 - ap[c].p50) <= 0.01 * span


def test_sql_positional_params_and_row_cap(spark):
    from cairn.operators import sqljobs
    io.scan(spark, SF_SMALL, "events").createOrReplaceTempView("events")
    df = sqljobs.run_sql(spark, "SELECT event_id FROM events WHERE event_type = ? AND value > ? ORDER BY event_id",
                         args=["click", 10], max_rows=5)
    want = [r.event_id for r in io.scan(spark, SF_SMALL, "events")
            .where("event_type = 'click' AND value > 10").orderBy("event_id").limit(5).collect()]
    assert [r.event_id for r in df.collect()] == want


def test_page_needs_total_order(spark):
    with pytest.raises(ValueError):
        io.page(io.scan(spark, SF_SMALL, "orders"), [], 10)


def test_reconcile_reports_type_change(spark):
    orders = io.scan(spark, SF_SMALL, "orders")
    changed = orders.withColumn("o_custkey", F.col("o_custkey").cast("int"))
    r = {x.column_name: x.replica_value for x in sync.reconcile(orders, changed, ["o_orderkey"]).collect()
         if x.check_name == "type_mismatch"}
    assert r["o_custkey"] == 1 and sum(r.values()) == 1


def test_table_stats_and_inventory_bytes(spark):
    from cairn.operators import catalog
    st = sync.table_stats(spark, f"{SF_SMALL}/orders.parquet").first()
    assert st.row_count == io.scan(spark, SF_SMALL, "orders").count() and st.size_bytes > 0
    inv = {r.table_name: r for r in catalog.schema_inventory(spark, SF_SMALL, ["orders", "nation"]).collect()}
    assert inv["nation"].row_count == 25 and inv["orders"].size_bytes == st.size_bytes
    assert inv["orders"].last_modified is not None


def test_query_result_of_failed_job_is_its_status(spark):
    from cairn.operators import sqljobs
    job = sqljobs.run_query_job(spark, "qfail", "SELECT * FROM no_such_table", "csv",
                                work_dir(spark, "t-q")).first().asDict()
    out = sqljobs.query_result(spark, job).first()
    assert out.status == "failed" and "no_such_table" in out.error


@pytest.mark.parametrize("kind", ["distinct", "third", "two values"])
def test_quantiles_of_many_rows_match_numpy(spark, kind):
    n = 60_000
    rng = np.random.default_rng(3)
    xs = rng.normal(size=n) if kind == "distinct" else rng.choice([0.0, 1.0], n)
    if kind == "third":
        xs = np.where(rng.random(n) < 1 / 3, 0.5, rng.normal(size=n))
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    long_df = df.select(F.lit(0).alias("g"), F.col("x").alias("v"))
    for accuracy, small in ((10000, 2000), (50, 20)):
        got = {r.q: r.value for r in profile.exact_quantiles(long_df, accuracy=accuracy, small=small).collect()}
        for q in profile.QUARTILES:
            assert math.isclose(got[q], np.quantile(xs, q), rel_tol=1e-9, abs_tol=1e-12), (kind, q)


def test_profiles_with_quotes_in_column_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None)], "`it's` double, `b``c` string")
    assert profile.profile_numeric(df).first().p50 == 2.0
    assert {r.column_name: r.null_count for r in profile.null_counts(df).collect()} == {"it's": 0, "b`c": 1}
    assert profile.profile_text(df).first().top == "a"
    assert profile.profile_table(df, "t").where("statistic = 'p50'").first().value == 2.0


def test_csv_results_split_only_without_line_breaks(spark):
    for text, whole in (("plain", False), ("two\nlines", True)):
        df = spark.createDataFrame([(1, text), (2, None)], "k int, v string")
        path = work_dir(spark, "t-csv")
        io.write_result(df, path, "csv")
        fs, mark = io._file(spark, f"{path}/_singleline")
        assert fs.exists(mark) != whole
        assert _rows(io.read_result(spark, path, "csv", df.schema).where("k = 1")) == [(1, text)]


def test_histogram_leaves_infinities_out(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double")
    rows = profile.histogram(df, "x", 2).orderBy("bin").collect()
    assert [(r.lower, r.upper, r["count"], r.outside) for r in rows] == [(0.0, 5.0, 1, 2), (5.0, 10.0, 1, 2)]


def test_stream_drops_out_of_order(spark):
    from cairn.streaming import streams
    ev = io.scan(spark, SF_SMALL, "events")
    root = work_dir(spark, "t-w1-order")
    ev.where("event_id >= 500").write.mode("append").parquet(f"{root}/src")   # later events first
    streams.stream_incremental(spark, f"{root}/src", ev.schema, f"{root}/out", f"{root}/ck")
    ev.where("event_id < 500").write.mode("append").parquet(f"{root}/src")
    streams.stream_incremental(spark, f"{root}/src", ev.schema, f"{root}/out", f"{root}/ck")
    assert _rows(streams.read_stream_replica(spark, f"{root}/out")) == _rows(ev)


def test_profile_table_with_catalog_row(spark, tables):
    from cairn.operators import catalog
    meta = catalog.table_metadata(tables["allowed_tables"], tables["table_metadata"], tables["table_tags"])
    first_id = meta.where(F.col("row_count") > 0).agg(F.min("table_id")).first()[0]
    info = meta.where(F.col("table_id") == first_id)
    rep = profile.profile_table(tables["nation"], "nation", info=info)
    got = {r.statistic: r.value for r in rep.where(F.col("column_name") == "*").collect()}
    row = info.first()
    assert got["catalog_row_count"] == row.row_count and got["catalog_size_bytes"] == row.size_bytes
    assert got["sample_rows"] == 25.0


def test_incremental_after_full_continues_without_duplicates(spark):
    ev = io.scan(spark, SF_SMALL, "events")
    early = ev.where("event_id < 400")
    rep = sync.Replica(spark, work_dir(spark, "t-full-inc"), "events")
    sync.sync_full(rep, early, "jf1", watermark_col="event_id")
    sync.sync_incremental(rep, ev, "event_id", "ji1")
    assert _rows(rep.read()) == _rows(ev)
    bare = sync.Replica(spark, work_dir(spark, "t-full-bare"), "events")
    sync.sync_full(bare, early, "jf1")
    with pytest.raises(ValueError):
        sync.sync_incremental(bare, ev, "event_id", "ji1")


def test_state_log_persists_operator_results(spark, tables):
    from cairn.sources.statelog import StateLog
    a = tables["artifacts"]
    schema = ", ".join(f"{n} {t}" for n, t in a.dtypes)
    state = StateLog(spark, work_dir(spark, "t-state"), ["artifact_id"], schema)
    state.upsert(a)
    updated = art.update(a, tables["artifact_patches"], ARTIFACT_CLOCK)
    state.upsert(updated.join(a, list(a.columns), "left_anti"))    # changed rows only
    assert _rows(state.current()) == _rows(updated)
    _, _, deleted = art.delete(updated, tables["artifact_tags"], tables["artifact_patches"])
    state.delete(deleted.select("artifact_id"))
    assert _rows(state.current()) == _rows(updated.join(deleted, "artifact_id", "left_anti"))


def test_state_log_nested_types(spark):
    from cairn.sources.statelog import StateLog
    schema = "k string, amount decimal(10,2), meta map<string,string>"
    state = StateLog(spark, work_dir(spark, "t-state2"), ["k"], schema)
    state.upsert(spark.createDataFrame([("a", 1.5, {"x": "1"}), ("b", 2.0, {})], "k string, amount double, meta map<string,string>")
                 .selectExpr("k", "CAST(amount AS DECIMAL(10,2)) AS amount", "meta"))
    state.delete(spark.createDataFrame([("b",)], "k string"))
    assert [(r.k, float(r.amount)) for r in state.current().collect()] == [("a", 1.5)]


def test_compact_keeps_rows_and_watermark(spark):
    ev = io.scan(spark, SF_SMALL, "events")
    rep = sync.Replica(spark, work_dir(spark, "t-compact"), "events")
    for i, cut in enumerate((200, 500, 800)):
        sync.sync_incremental(rep, ev.where(f"event_id < {cut}"), "event_id", f"ji{i}")
    before = _rows(rep.read())
    sync.compact(rep, "jc1")
    assert _rows(rep.read()) == before
    assert rep.current_batches().count() == 1
    sync.sync_incremental(rep, ev, "event_id", "ji9")   # continues from the carried watermark
    assert _rows(rep.read()) == _rows(ev)


def test_query_job_log_records_transitions(spark):
    from cairn.operators import sqljobs
    io.scan(spark, SF_SMALL, "events").createOrReplaceTempView("events")
    log = sqljobs.query_job_log(spark, work_dir(spark, "t-qlog"))
    now = "2024-01-28 00:00:00"
    sqljobs.run_query_job(spark, "q1", "SELECT count(*) AS n FROM events", "json", work_dir(spark, "t-q1"),
                          log=log, now=now)
    sqljobs.run_query_job(spark, "q2", "SELECT * FROM missing_table", "json", work_dir(spark, "t-q2"),
                          log=log, now=now)
    cur = {r.job_id: (r.status, r.row_count) for r in log.current().collect()}
    assert cur == {"q1": ("completed", 1), "q2": ("failed", None)}
    steps = [r.status for r in log.log().where("job_id = 'q1'").orderBy("_seq").collect()]
    assert steps == ["pending", "running", "completed"]


def test_state_log_compaction(spark, tables):
    from cairn.sources.statelog import StateLog
    a = tables["artifacts"]
    state = StateLog(spark, work_dir(spark, "t-state3"), ["artifact_id"], ", ".join(f"{n} {t}" for n, t in a.dtypes))
    state.upsert(a)
    state.upsert(art.update(a, tables["artifact_patches"], ARTIFACT_CLOCK))
    state.delete(a.where("type = 'model'").select("artifact_id"))
    compact = state.compact_to(work_dir(spark, "t-state3c"))
    assert _rows(compact.current()) == _rows(state.current())
    assert compact.log().count() == state.current().count()
    compact.delete(a.where("type = 'data'").select("artifact_id"))     # keeps working after the switch
    assert compact.current().where("type IN ('model', 'data')").count() == 0


def test_profile_text_lists_all_null_columns(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "s string, t string")
    r = {x.column_name: (x["count"], x.unique, x.top, x.freq) for x in profile.profile_text(df).collect()}
    assert r == {"s": (2, 1, "a", 2), "t": (0, 0, None, None)}
