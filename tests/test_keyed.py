"""The replica in key buckets against ``sync.upsert`` applied delta by delta."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import sync
from cairn.operators.keyed import KeyedReplica
from cairn.session import work_dir

SCHEMA = "k bigint, j string, v double, ver int"


def frame(spark, rng, n, keys):
    rows = [(rng.choice([None, *range(keys)]), rng.choice(["a", "b", None]), rng.choice([None, rng.random()]), rng.choice([None, 1, 2, 3, 4])) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("version", [None, "ver"])
def test_deltas_and_compactions_match_plain_upserts(spark, version):
    rng = random.Random(str(version))
    rep = KeyedReplica(spark, work_dir(spark, "t-keyed"), ["k", "j"], buckets=5)
    base = frame(spark, rng, 60, 20)  # repeated and null keys
    rep.load(base, "load")
    want = spark.createDataFrame(base.collect(), SCHEMA)
    for step in range(4):
        delta = frame(spark, rng, (15, 1, 0, 40)[step], 25)
        rep.upsert(delta, f"d{step}", version)
        want = spark.createDataFrame(sync.upsert(want, delta, ["k", "j"], version).collect(), SCHEMA)
        assert rows_of(rep.read()) == rows_of(want)
        if step in (1, 3):
            rep.compact_buckets(f"c{step}", most_replaced=0.1, most_batches=2)
            assert rows_of(rep.read()) == rows_of(want)
            assert all(gone <= 0.1 * n and batches <= 2 for n, gone, batches in rep.load_of_buckets(rep.snapshot()).values())
    rep.upsert(frame(spark, rng, 9, 9), "d1", version)  # a job that is done
    assert rows_of(rep.read()) == rows_of(want)
    fresh = KeyedReplica(spark, rep.root, ["k", "j"], buckets=99)
    assert fresh.buckets == 5 and rows_of(fresh.read()) == rows_of(want)
    with pytest.raises(ValueError):
        KeyedReplica(spark, rep.root, ["k"])


def test_few_keys_write_little(spark):
    rep = KeyedReplica(spark, work_dir(spark, "t-keyed-share"), ["id"], buckets=8)
    rep.load(spark.range(50000).withColumn("v", F.col("id") * 2), "load")
    before = rep.snapshot().done[-1]
    job = rep.upsert(spark.range(0, 50000, 1000).withColumn("v", F.lit(-1).cast("bigint")), "few")
    assert (job["rows_processed"], job["deleted"]) == (50, 50) and before["rows_processed"] == 50000
    assert rep.read().where("v = -1").count() == 50 and rep.read().count() == 50000
    assert rep.compact_buckets("none", most_replaced=0.2) is None
    # One bucket full of replaced rows is rewritten, the others stay where they are.
    due = rep.read().select("*", rep._bucket()).where("_bucket = 3").drop("_bucket")
    rep.upsert(due.withColumn("v", F.lit(7).cast("bigint")), "bucket")
    done = rep.compact_buckets("one")
    assert done["rewrote"] == [3] and rep.read().count() == 50000
    assert rep.read().where("v = 7").count() == done["rows_processed"]


def test_new_columns_watermarks_and_vacuum(spark):
    rep = KeyedReplica(spark, work_dir(spark, "t-keyed-cols"), ["k"], buckets=2)
    assert rep.read().columns == []
    rep.upsert(spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), "a", watermark_col="k")
    assert rep.snapshot().done[-1]["last_value"] == "2"
    rep.upsert(spark.createDataFrame([(2, "z", 5), (3, "w", 6)], "k int, a string, b int"), "b")
    assert rows_of(rep.read()) == rows_of(spark.createDataFrame([(1, "x", None), (2, "z", 5), (3, "w", 6)], "k int, a string, b int"))
    with pytest.raises(ValueError, match="column types changed"):
        rep.upsert(spark.createDataFrame([("2", "z")], "k string, a string"), "c")
    assert rep.snapshot().entries[-1]["status"] == "failed" and rep.read().count() == 3
    rep.compact_buckets("all", most_replaced=0.0, most_batches=0)
    want = rows_of(rep.read())
    assert rep.vacuum(grace_hours=0.0) >= 2 and rows_of(rep.read()) == want
    rep.load(spark.createDataFrame([(9, "n")], "k int, a string"), "again")
    assert [tuple(r) for r in rep.read().collect()] == [(9, "n")]


def test_an_upsert_that_loses_starts_again(spark, monkeypatch):
    root = work_dir(spark, "t-keyed-race")
    a, b = KeyedReplica(spark, root, ["id"], buckets=3), KeyedReplica(spark, root, ["id"], buckets=3)
    a.load(spark.range(30).withColumn("v", F.lit(0)), "load")
    store, calls = a._store, []

    def slow(*args, **kw):
        if not calls:
            calls.append(b.upsert(spark.range(5, 15).withColumn("v", F.lit(2)), "b"))
        return store(*args, **kw)

    monkeypatch.setattr(a, "_store", slow)
    a.upsert(spark.range(10).withColumn("v", F.lit(1)), "a")
    got = {r.id: r.v for r in b.read().collect()}
    assert b.read().count() == 30 and got == {i: 1 if i < 10 else 2 if i < 15 else 0 for i in range(30)}
