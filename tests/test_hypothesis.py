"""Generated inputs (Hypothesis): exact quartiles against numpy, and nested
hash samples.  Few examples each: every example is a Spark job."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators import profile
from cairn.sources import io
from tests.conftest import SF_SMALL

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

# Values drawn from a small pool so repeats (ties, hot values) are common.
values = st.lists(st.sampled_from([-3.5, -1.0, 0.0, 0.25, 1.0, 2.0, 7.75, 1e6]) | st.floats(-1e3, 1e3),
                  min_size=1, max_size=300)


@SETTINGS
@given(xs=values, accuracy=st.sampled_from([5, 20, 10000]), small=st.sampled_from([1, 10, 2000]))
def test_exact_quartiles_match_numpy(spark, xs, accuracy, small):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    long_df = df.select(F.lit(0).alias("g"), F.col("x").alias("v"))
    got = {r.q: r.value for r in profile.exact_quantiles(long_df, accuracy=accuracy, small=small).collect()}
    want = np.quantile(np.array(xs, dtype=float), profile.QUARTILES)
    for q, w in zip(profile.QUARTILES, want):
        assert math.isclose(got[q], w, rel_tol=1e-9, abs_tol=1e-9), (q, got[q], w)


@SETTINGS
@given(f1=st.floats(0, 1), f2=st.floats(0, 1))
def test_hash_samples_are_nested(spark, f1, f2):
    lo, hi = sorted((f1, f2))
    ev = io.scan(spark, SF_SMALL, "events").select("event_id")
    small = profile.sample_hash(ev, ["event_id"], lo)
    big = profile.sample_hash(ev, ["event_id"], hi)
    assert small.join(big, "event_id", "left_anti").count() == 0


rows = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3)), min_size=0, max_size=40)


@SETTINGS
@given(src=rows, tgt=rows)
def test_reconcile_matches_brute_force(spark, src, tgt):
    from collections import Counter
    from cairn.operators import sync
    schema = "k int, v int"
    s_df, t_df = spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema)
    got = {(r.check_name, r.column_name): r.replica_value for r in sync.reconcile(s_df, t_df, ["k"]).collect()}
    sk, tk = Counter(k for k, _ in src), Counter(k for k, _ in tgt)
    rows_by = lambda data, key: Counter(v for k, v in data if k == key)
    want_only_s = sum(n for k, n in sk.items() if k not in tk)
    want_only_t = sum(n for k, n in tk.items() if k not in sk)
    want_changed = sum(1 for k in sk if k in tk and rows_by(src, k) != rows_by(tgt, k))
    assert got[("only_in_source", "*")] == want_only_s
    assert got[("only_in_replica", "*")] == want_only_t
    assert got[("changed", "*")] == want_changed
    assert got[("row_count", "*")] == len(tgt)


@SETTINGS
@given(target=st.dictionaries(st.integers(0, 9), st.integers(0, 5), max_size=10),
       delta=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 5), st.integers(0, 3)), max_size=30))
def test_upsert_matches_brute_force(spark, target, delta):
    from cairn.operators import sync
    t_df = spark.createDataFrame(list(target.items()), "k int, v int")
    d_df = spark.createDataFrame(delta, "k int, v int, ver int")
    got = {r.k: r.v for r in sync.upsert(t_df, d_df, ["k"], "ver").collect()}
    want = dict(target)
    best = {}
    for k, v, ver in delta:            # largest version wins; ties: any of them
        if k not in best or ver > best[k][0]:
            best[k] = (ver, {v})
        elif ver == best[k][0]:
            best[k][1].add(v)
    for k, (_, vs) in best.items():
        want[k] = vs
    assert set(got) == set(want)
    for k, v in got.items():
        assert v in want[k] if isinstance(want[k], set) else v == want[k]


actions = st.lists(st.tuples(st.sampled_from(["x", "y", "z"]), st.sampled_from(["add", "remove"]),
                             st.integers(0, 5)), max_size=25)


@SETTINGS
@given(acts=actions, in_source=st.sets(st.sampled_from(["x", "y", "z"])))
def test_catalog_fold_matches_sequential_rules(spark, acts, in_source):
    import datetime as dt
    from cairn.operators import catalog
    rows = [(i, "s", t, a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for i, (t, a, h) in enumerate(acts)]
    df = spark.createDataFrame(rows, "action_id bigint, schema_name string, table_name string, action string, ts timestamp_ntz")
    src = spark.createDataFrame([("s", t) for t in sorted(in_source)], "schema_name string, table_name string")
    state, err = catalog.catalog_state(df, src)
    got = {r.table_name: (r.table_id, r.status, r.created_at) for r in state.collect()}
    got_err = {r.action_id for r in err.collect()}
    # Sequential fold of the rules in (ts, action_id) order.
    want, want_err = {}, set()
    for i, _, t, a, ts in sorted(rows, key=lambda r: (r[4], r[0])):
        cur = want.get(t)
        if a == "add":
            if cur is None:
                if t in in_source:
                    want[t] = [f"t{i}", "active", ts]
                else:
                    want_err.add(i)
            elif cur[1] == "inactive":
                cur[1], cur[2] = "active", ts
        else:
            if cur is None:
                want_err.add(i)
            else:
                cur[1] = "inactive"
    assert got == {t: tuple(v) for t, v in want.items()}
    assert got_err == want_err


@SETTINGS
@given(groups=st.lists(values, min_size=2, max_size=4), accuracy=st.sampled_from([5, 20, 10000]), small=st.sampled_from([1, 10, 2000]))
def test_exact_quartiles_many_groups(spark, groups, accuracy, small):
    data = [(g, float(x)) for g, xs in enumerate(groups) for x in xs]
    long_df = spark.createDataFrame(data, "g int, v double")
    got = {(r.g, r.q): r.value for r in
           profile.exact_quantiles(long_df, accuracy=accuracy, small=small).collect()}
    for g, xs in enumerate(groups):
        want = np.quantile(np.array(xs, dtype=float), profile.QUARTILES)
        for q, w in zip(profile.QUARTILES, want):
            assert math.isclose(got[(g, q)], w, rel_tol=1e-9, abs_tol=1e-9), (g, q, got[(g, q)], w)


jobs = st.lists(st.tuples(st.sampled_from(["completed", "failed", "running", "pending"]),
                          st.one_of(st.none(), st.integers(0, 120))), max_size=30)


@SETTINGS
@given(rows=jobs)
def test_retention_matches_rules(spark, rows):
    import datetime as dt
    from cairn.operators import joblog
    now = dt.datetime(2024, 1, 28)
    data = [(f"j{i}", st_, None if h is None else now - dt.timedelta(hours=h)) for i, (st_, h) in enumerate(rows)]
    df = spark.createDataFrame(data, "job_id string, status string, completed_at timestamp_ntz")
    got = {r.job_id for r in joblog.retention_delete(df, "2024-01-28 00:00:00").collect()}
    want = {j for j, s, c in data
            if not (c is not None and ((s == "completed" and c < now - dt.timedelta(hours=24))
                                       or (s == "failed" and c < now - dt.timedelta(hours=72))))}
    assert got == want


@SETTINGS
@given(expiry=st.lists(st.integers(0, 40), min_size=1, max_size=8),
       access=st.lists(st.tuples(st.integers(0, 7), st.integers(0, 40)), max_size=20))
def test_touch_matches_rules(spark, expiry, access):
    import datetime as dt
    from cairn.operators import artifacts as art
    base = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(f"a{i}", base + dt.timedelta(days=d)) for i, d in enumerate(expiry)],
                              "artifact_id string, expires_at timestamp_ntz")
    acc = spark.createDataFrame([(f"a{i}", base + dt.timedelta(days=d)) for i, d in access],
                                "artifact_id string, accessed_at timestamp_ntz")
    own = F.lit("own").alias("swarm_token")
    got = {r.artifact_id: r.expires_at for r in art.touch(a.select("*", own), acc.select("*", own)).collect()}
    for i, d in enumerate(expiry):
        last = [base + dt.timedelta(days=x) for j, x in access if j == i]
        want = base + dt.timedelta(days=d)
        if last:
            want = max(want, max(last) + dt.timedelta(days=10))
        assert got[f"a{i}"] == want


@SETTINGS
@given(xs=st.lists(st.integers(-50, 50), min_size=1, max_size=60), bins=st.integers(1, 8))
def test_histogram_matches_numpy(spark, xs, bins):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r["count"] for r in profile.histogram(df, "x", bins).orderBy("bin").collect()]
    lo, hi = min(xs), max(xs)
    want, _ = np.histogram(np.array(xs, dtype=float), bins=bins, range=(lo, hi) if hi > lo else (lo, lo + 1))
    if hi == lo:
        want = [len(xs)] + [0] * (bins - 1)
    assert got == [int(w) for w in want]


@SETTINGS
@given(cols=st.lists(st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "dd"])), min_size=5, max_size=5),
                     min_size=1, max_size=30))
def test_profile_text_matches_rules(spark, cols):
    from collections import Counter
    names = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([tuple(r) for r in cols], ", ".join(f"{n} string" for n in names))
    got = {r.column_name: (r["count"], r.unique, r.top, r.freq) for r in profile.profile_text(df).collect()}
    for i, n in enumerate(names):
        vals = Counter(r[i] for r in cols if r[i] is not None)
        if not vals:
            assert got[n] == (0, 0, None, None)
            continue
        freq = max(vals.values())
        top = min(v for v, c in vals.items() if c == freq)
        assert got[n] == (sum(vals.values()), len(vals), top, freq)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cuts=st.lists(st.integers(0, 1000), min_size=1, max_size=4), full_first=st.booleans())
def test_incremental_steps_equal_source(spark, cuts, full_first):
    from cairn.operators import sync
    from cairn.session import work_dir
    ev = io.scan(spark, SF_SMALL, "events")
    rep = sync.Replica(spark, work_dir(spark, "h-inc"), "events")
    if full_first:
        sync.sync_full(rep, ev.where(f"event_id < {cuts[0]}"), "jf", watermark_col="event_id")
    seen = cuts[0] if full_first else 0
    for i, cut in enumerate(cuts):
        # The source only grows: each step sees at least what the last one saw.
        seen = max(seen, cut)
        sync.sync_incremental(rep, ev.where(f"event_id < {seen}"), "event_id", f"ji{i}")
    got = sorted(r.event_id for r in rep.read().select("event_id").collect())
    assert got == list(range(seen))


@SETTINGS
@given(fraction=st.floats(0, 1))
def test_hash_sample_equals_duckdb(spark, fraction):
    import duckdb
    ev = io.scan(spark, SF_SMALL, "events")
    got = sorted(r.event_id for r in profile.sample_hash(ev, ["event_id"], fraction).select("event_id").collect())
    want = sorted(r[0] for r in duckdb.sql(
        f"SELECT event_id FROM read_parquet('{SF_SMALL}/events.parquet') "
        f"WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT < {fraction!r} * 4294967296").fetchall())
    assert got == want
