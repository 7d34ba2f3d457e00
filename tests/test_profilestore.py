"""Profile states per batch: merged equal to one state of all rows, each batch read once."""

import random

from pyspark.sql import functions as F

from cairn.operators import profilestore as ps
from cairn.operators import sync
from cairn.session import work_dir


def test_merged_states_equal_one_state(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, rng.random() * 1e6, float("nan")]), rng.choice([None, "x", "y", str(rng.random())]), rng.choice([None, [1, 2]])) for _ in range(900)]
    schema = "v double, t string, a array<int>"
    parts = [spark.createDataFrame(rows[i:j], schema) for i, j in ((0, 10), (10, 10), (10, 500), (500, 900))]
    states = ps.state_of(parts[0])
    for p in parts[1:]:
        states = states.unionByName(ps.state_of(p))
    got = {r.column_name: r for r in ps.merge_states(states).collect()}
    want = {r.column_name: r for r in ps.merge_states(ps.state_of(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {"v", "t", "a"}
    for c, w in want.items():
        g = got[c]
        assert (g["count"], g.null_count, g.min, g.max, g.min_text, g.max_text) == (w["count"], w.null_count, w.min, w.max, w.min_text, w.max_text)
        assert abs(g.approx_unique - w.approx_unique) <= 0.02 * w.approx_unique
        for x in ("mean", "std"):
            assert g[x] is w[x] is None or abs(g[x] - w[x]) <= 1e-9 * abs(w[x])
    seen = [r[0] for r in rows if r[0] is not None and r[0] == r[0]]
    assert got["v"]["count"] == len(seen) and got["v"].null_count == 900 - len(seen)
    assert abs(sum(x <= got["v"].p50 for x in seen) / len(seen) - 0.5) < 0.02


def test_each_batch_is_profiled_once(spark, monkeypatch):
    rep = sync.Replica(spark, work_dir(spark, "t-states"))
    store = ps.ProfileStore(rep)
    assert store.report().count() == 0 and store.refresh() == []
    sync.sync_full(rep, spark.range(10).selectExpr("id AS k"), "a", watermark_col="k")
    assert store.refresh() == ["a"] and store.refresh() == []
    sync.sync_incremental(rep, spark.range(25).selectExpr("id AS k", "'x' AS added"), "k", "b")
    report = {r.column_name: r for r in ps.ProfileStore(rep).report().collect()}
    assert (report["k"]["count"], report["k"].max, report["added"]["count"], report["added"].null_count) == (25, 24.0, 15, 10)
    assert store.refresh() == [] and [e["job_id"] for e in store.commits.entries()] == ["a", "b"]
    # A second state of the same batch, as from another writer, doesn't count twice.
    first = store.commits.entries()[0]
    store.commits.append({**first, "state": "nowhere"})
    assert ps.ProfileStore(rep).report().where("column_name = 'k'").first()["count"] == 25
    sync.compact(rep, "c", "k")
    assert store.refresh() == ["c"] and store.report().where("column_name = 'k'").select(F.col("count")).first()[0] == 25
