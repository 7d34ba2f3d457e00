"""Skewed inputs: one key holds a third of all rows.  Results are checked
against a brute-force pandas computation on the same (small) input."""

import math

import numpy as np
from pyspark.sql import functions as F

from cairn.functions.core import latest_per_key
from cairn.operators import artifacts as art
from cairn.operators import catalog, profile, sync
from tests.conftest import SF_MID


def _hot_events(spark):
    ev = spark.read.parquet(f"{SF_MID}/events.parquet")
    # Every third event belongs to user 0.
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))


def test_latest_per_key_hot_key(spark):
    ev = _hot_events(spark)
    got = {r.user_id: (r.event_id, r.value) for r in
           latest_per_key(ev.select("user_id", "event_id", "value", "ts"), ["user_id"], ["ts", "event_id"]).collect()}
    pdf = ev.select("user_id", "event_id", "value", "ts").toPandas().sort_values(["ts", "event_id"])
    want = {int(u): (int(g.iloc[-1].event_id), float(g.iloc[-1].value)) for u, g in pdf.groupby("user_id")}
    assert got == want


def test_upsert_hot_key_many_versions(spark):
    ev = _hot_events(spark)
    target = ev.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.lit(0.0).alias("value"))
    delta = ev.select("user_id", "event_id", "value")
    out = {r.user_id: r.event_id for r in sync.upsert(target, delta, ["user_id"], "event_id").collect()}
    pdf = ev.select("user_id", "event_id").toPandas()
    assert out == {int(u): int(g.event_id.max()) for u, g in pdf.groupby("user_id")}


def test_reconcile_hot_key(spark):
    ev = _hot_events(spark).select("user_id", "event_id", "value")
    changed = ev.withColumn("value", F.when(F.col("event_id") == 3, F.lit(-1.0)).otherwise(F.col("value")))
    r = {x.check_name: x.replica_value for x in sync.reconcile(ev, changed, ["user_id"]).collect()
         if x.column_name == "*"}
    assert r["changed"] == 1 and r["only_in_source"] == 0 and r["only_in_replica"] == 0


def test_exact_quantiles_hot_value(spark):
    ev = _hot_events(spark)
    p = {r.column_name: r for r in profile.profile_numeric(ev.select("user_id", "value")).collect()}
    pdf = ev.select("user_id", "value").toPandas()
    for c in ("user_id", "value"):
        q = np.quantile(pdf[c].astype(float), [0.25, 0.5, 0.75])
        assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
                   for a, b in zip((p[c].p25, p[c].p50, p[c].p75), q)), c


def test_profile_text_hot_value(spark):
    ev = _hot_events(spark).select(F.col("user_id").cast("string").alias("u"))
    r = profile.profile_text(ev).first()
    pdf = ev.toPandas()
    vc = pdf.u.value_counts()
    assert (r.top, r.freq, r.unique, r["count"]) == ("0", int(vc.max()), int(vc.size), len(pdf))


def test_catalog_state_hot_table(spark):
    ev = _hot_events(spark)
    acts = ev.select(F.col("event_id").alias("action_id"), F.lit("s").alias("schema_name"),
                     F.concat(F.lit("tab"), F.col("user_id")).alias("table_name"),
                     F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"), "ts")
    src = acts.select("schema_name", "table_name").distinct()
    state = {r.table_name: (r.status, r.created_at) for r in catalog.catalog_state(acts, src)[0].collect()}
    pdf = acts.toPandas().sort_values(["ts", "action_id"])
    want = {}
    for t, g in pdf.groupby("table_name"):
        adds = g[g.action == "add"]
        if adds.empty:
            continue
        g = g[g.ts >= adds.ts.iloc[0]]
        prev, created = None, None
        for a, ts in zip(g.action, g.ts):
            if a == "add" and prev in (None, "remove"):
                created = ts
            prev = a
        want[t] = ("active" if prev == "add" else "inactive", created.to_pydatetime())
    assert state == want


def test_touch_hot_artifact(spark, tables):
    acc = tables["artifact_access"].withColumn(
        "artifact_id", F.when(F.col("access_id") % 3 == 0, F.lit("a00000001")).otherwise(F.col("artifact_id"))) \
        .withColumn("swarm_token", F.lit("swarm1"))
    a = tables["artifacts"]
    out = {r.artifact_id: r.expires_at for r in art.touch(a, acc).collect()}
    last = acc.where(F.col("artifact_id") == "a00000001").agg(F.max("accessed_at")).first()[0]
    old = a.where(F.col("artifact_id") == "a00000001").first().expires_at
    import datetime as dt
    assert out["a00000001"] == max(old, last + dt.timedelta(days=10))
