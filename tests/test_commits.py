"""Several writers: numbered log entries, jobs that lose and start again, half-written batches, violations."""

import threading

import pytest
from pyspark.sql import functions as F

from cairn.operators import sync
from cairn.session import work_dir
from cairn.sources import commitlog
from cairn.sources.statelog import StateLog


def together(jobs):
    errors = []

    def guarded(job):
        try:
            job()
        except Exception as exc:
            errors.append(exc)
    threads = [threading.Thread(target=guarded, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors, errors


def test_every_number_has_one_writer(spark, monkeypatch):
    monkeypatch.setattr(commitlog, "CHECKPOINT_EVERY", 7)
    path = work_dir(spark, "t-commits")
    won: dict[int, set] = {w: set() for w in range(4)}

    def writer(w):
        log = commitlog.CommitLog(spark, path)
        for _ in range(8):
            won[w].add(log.append({"by": w}))

    together([lambda w=w: writer(w) for w in won])
    assert sorted(n for s in won.values() for n in s) == list(range(32))
    log = commitlog.CommitLog(spark, path)
    assert [e["seq"] for e in log.entries()] == list(range(32))
    assert all(e["seq"] in won[e["by"]] for e in log.entries())
    assert not log.put(5, {"by": 9}) and log.put(32, {"by": 9})
    # A reader with nothing in memory starts from the checkpoint and doesn't open the entries before it.
    fresh, opened = commitlog.CommitLog(spark, path), []
    read = fresh._read
    monkeypatch.setattr(fresh, "_read", lambda name: opened.append(name) or read(name))
    assert len(fresh.entries()) == 33 and opened[0].startswith("checkpoint-") and len(opened) <= 8
    assert fresh.frame("by int, seq bigint").count() == 33


def source(spark, n):
    return spark.range(n).selectExpr("id AS k", "id * 2 AS v")


def test_the_job_that_loses_starts_again(spark):
    root = work_dir(spark, "t-race")
    a, b = sync.Replica(spark, root), sync.Replica(spark, root)
    sync.sync_full(a, source(spark, 10), "f", watermark_col="k")
    seen = []

    def plan(snapshot):
        seen.append(snapshot.watermark())
        if len(seen) == 1:  # another job copies the same rows meanwhile
            sync.sync_incremental(b, source(spark, 20), "k", "other")
        return sync.Batch(source(spark, 30).where(F.col("k") > int(snapshot.watermark())), "incremental", watermark_col="k")

    job = a.run("mine", plan)
    assert seen == ["9", "19"] and job["rows_processed"] == 10 and job["seq"] == 2
    assert sorted(r.k for r in a.read().collect()) == list(range(30))
    # A full copy doesn't depend on what was there: it takes the next number.
    calls = []

    def full(snapshot):
        calls.append(1)
        sync.sync_incremental(b, source(spark, 40), "k", f"more{len(calls)}")
        return sync.Batch(source(spark, 5), "full", watermark_col="k")

    assert a.run("whole", full)["seq"] == 4 and calls == [1] and b.read().count() == 5


def test_jobs_at_the_same_time_copy_each_row_once(spark):
    root = work_dir(spark, "t-threads")
    sync.sync_full(sync.Replica(spark, root), source(spark, 5), "f", watermark_col="k")
    together([lambda i=i: sync.sync_incremental(sync.Replica(spark, root), source(spark, 5 + 10 * i), "k", f"j{i}") for i in (1, 2, 3)])
    rows = [r.k for r in sync.Replica(spark, root).read().collect()]
    assert sorted(rows) == list(range(35))


def test_same_job_id_from_two_writers_is_done_once(spark):
    root = work_dir(spark, "t-same")
    a, b = sync.Replica(spark, root), sync.Replica(spark, root)
    done = []

    def plan(snapshot):
        if not done:
            done.append(sync.sync_full(b, source(spark, 10), "job"))
        return sync.Batch(source(spark, 99), "full")

    assert a.run("job", plan)["folder"] == done[0]["folder"] and a.read().count() == 10
    assert len(a.snapshot().done) == 1


def test_state_log_with_two_writers(spark):
    path = work_dir(spark, "t-state-two")
    logs = [StateLog(spark, path, ["k"], "k bigint, v string") for _ in range(3)]
    together([lambda i=i: logs[i].upsert(spark.createDataFrame([(1, f"w{i}"), (10 + i, "x")], "k bigint, v string")) for i in range(3)])
    rows = {r.k: r.v for r in logs[0].current().collect()}
    assert set(rows) == {1, 10, 11, 12}
    last = logs[1].log().where("k = 1").orderBy(F.col("_seq").desc()).first()
    assert rows[1] == last.v and logs[0].log().select("_seq").distinct().count() == 3
    # A change that fails half-way isn't there.
    with pytest.raises(Exception):
        logs[0].upsert(spark.range(3).selectExpr("id AS k", "if(id = 2, raise_error('no'), 'y') AS v"))
    assert logs[0].log().count() == 6


def test_violations_are_logged_or_fatal(spark):
    rep = sync.Replica(spark, work_dir(spark, "t-violations"))
    src = spark.createDataFrame([("1", "ab", "x"), ("no", "abcdef", "y"), (None, None, None)], "k string, name string, must string")
    cols = spark.createDataFrame([("t", 1, "k", "NUMBER(10,0)", "Y"), ("t", 2, "name", "VARCHAR(3)", "Y"), ("t", 3, "must", "VARCHAR(3)", "N")],
                                 "table_name string, ordinal int, name string, declared_type string, nullable string")
    bad = sync.sync_full(rep, src, "bad", columns=cols)
    assert bad["status"] == "failed" and "must.null_in_not_null (1)" in bad["error_message"] and not rep.read().columns
    assert bad["violations"] == {"k.cast_failed": 1, "name.too_long": 1, "must.null_in_not_null": 1}
    good = sync.sync_full(rep, src.where("must is not null"), "good", columns=cols)
    assert good["status"] == "completed" and good["violations"] == {"k.cast_failed": 1, "name.too_long": 1}
    assert rep.log().where("job_id = 'good'").first().violations == good["violations"]
    assert sorted(map(tuple, rep.read().collect()), key=repr) == [(1.0, "ab", "x"), (None, "abcdef", "y")]
    key = sync.sync_full(rep, src.where("must is not null"), "key", columns=cols, watermark_col="k")
    assert key["status"] == "failed" and "k.cast_failed (1)" in key["error_message"] and rep.read().count() == 2
