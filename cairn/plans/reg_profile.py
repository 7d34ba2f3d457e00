"""Registered queries: sampling and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import profile
from cairn.plans.fixtures import Tables
from cairn.plans.registry import register
from cairn.sources import io

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


@register("sample_first", "P1", "SELECT * FROM events ORDER BY event_id LIMIT 100")
def sample_first(spark, sf):
    return profile.sample_first(io.scan(spark, sf, "events"), 100, ["event_id"])


@register("sample_random", "P2")
def sample_random(spark, sf):
    return profile.sample_random(io.scan(spark, sf, "events"), 0.1, seed=42)


@register("sample_hash", "P3", """
SELECT * FROM lineitem
WHERE ('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), 1, 8))::BIGINT
      < 0.1 * 4294967296""")
def sample_hash(spark, sf):
    return profile.sample_hash(io.scan(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 0.1)


def _r(c):
    return F.round(F.col(c), 6).alias(c)


def _numeric_oracle(table, cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS count, round(avg({x}), 6) AS mean,"
            f" round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min,"
            f" round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50,"
            f" round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM {table}")
    return "\nUNION ALL\n".join(parts)


@register("profile_numeric", "P4", _numeric_oracle("lineitem", LINEITEM_NUMERIC))
def profile_numeric(spark, sf):
    p = profile.profile_numeric(io.scan(spark, sf, "lineitem"))
    return p.select("column_name", "count", *[_r(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def _us(c):
    return f"CAST(epoch_us({c}) AS DOUBLE)"


def _ts(expr):
    return f"make_timestamp(CAST(round({expr}) AS BIGINT))"


@register("profile_datetime", "P5", f"""
SELECT 'o_orderdate' AS column_name, count(o_orderdate) AS count,
  {_ts(f"avg({_us('o_orderdate')})")} AS mean, {_ts(f"min({_us('o_orderdate')})")} AS min,
  {_ts(f"quantile_cont({_us('o_orderdate')}, 0.25)")} AS p25, {_ts(f"quantile_cont({_us('o_orderdate')}, 0.5)")} AS p50,
  {_ts(f"quantile_cont({_us('o_orderdate')}, 0.75)")} AS p75, {_ts(f"max({_us('o_orderdate')})")} AS max
FROM orders""")
def profile_datetime(spark, sf):
    return profile.profile_datetime(io.scan(spark, sf, "orders"))


@register("profile_text", "P6", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c})
   ORDER BY n DESC, v LIMIT 1) AS top, max(n) AS freq
FROM (SELECT {c}, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c})""" for c in ("o_orderstatus", "o_orderpriority")))
def profile_text(spark, sf):
    p = profile.profile_text(io.scan(spark, sf, "orders"))
    return p.select("column_name", F.col("count").cast("bigint").alias("count"), "unique", "top", "freq")


_NULL_SRC = ("SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice, o.o_orderdate "
             "FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")


@register("null_counts", "P7", f"""
WITH j AS ({_NULL_SRC})
SELECT 'c_custkey' AS column_name, count(*) FILTER (WHERE c_custkey IS NULL) AS null_count FROM j
UNION ALL SELECT 'c_name', count(*) FILTER (WHERE c_name IS NULL) FROM j
UNION ALL SELECT 'o_orderkey', count(*) FILTER (WHERE o_orderkey IS NULL) FROM j
UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice IS NULL OR isnan(o_totalprice)) FROM j
UNION ALL SELECT 'o_orderdate', count(*) FILTER (WHERE o_orderdate IS NULL) FROM j""")
def null_counts(spark, sf):
    c = io.scan(spark, sf, "customer").select("c_custkey", "c_name")
    o = io.scan(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    j = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", "o_orderkey",
                                                            "o_totalprice", "o_orderdate")
    return profile.null_counts(j)


def _profile_table_oracle():
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    parts = []
    num = _numeric_oracle("lineitem", LINEITEM_NUMERIC)
    for s in stats:
        parts.append(f"SELECT column_name, '{s}' AS statistic, CAST({s} AS DOUBLE) AS value FROM num")
    dt = _us("l_shipdate")
    dexpr = {"count": f"count({dt})", "mean": f"avg({dt})", "min": f"min({dt})",
             "p25": f"quantile_cont({dt}, 0.25)", "p50": f"quantile_cont({dt}, 0.5)",
             "p75": f"quantile_cont({dt}, 0.75)", "max": f"max({dt})"}
    for s, e in dexpr.items():
        parts.append(f"SELECT 'l_shipdate', '{s}', round(CAST({e} AS DOUBLE), 0) FROM lineitem")
    cols = LINEITEM_NUMERIC + ["l_returnflag", "l_linestatus", "l_shipdate"]
    for c in cols:
        miss = f"{c} IS NULL" + (f" OR isnan({c})" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else "")
        parts.append(f"SELECT '{c}', 'null_count', CAST(count(*) FILTER (WHERE {miss}) AS DOUBLE) FROM lineitem")
    parts.append("SELECT '*', 'sample_rows', CAST(count(*) AS DOUBLE) FROM lineitem")
    body = "\nUNION ALL\n".join(parts)
    return f"WITH num AS ({num}),\nlong AS ({body})\nSELECT 'lineitem' AS table_name, column_name, statistic, value FROM long"


@register("profile_table", "P8", _profile_table_oracle())
def profile_table(spark, sf):
    p = profile.profile_table(io.scan(spark, sf, "lineitem"), "lineitem", fraction=1.0)
    return p.select("table_name", "column_name", "statistic", F.round("value", 6).alias("value"))


@register("histogram", "P9", """
WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 10) AS INTEGER) + 1, 10) AS bin
      FROM lineitem, mm),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 11))
SELECT bins.bin, round(lo + (bins.bin - 1) * (hi - lo) / 10, 6) AS lower, round(lo + bins.bin * (hi - lo) / 10, 6) AS upper,
  CAST(count(b.bin) AS BIGINT) AS count
FROM bins CROSS JOIN mm LEFT JOIN b ON b.bin = bins.bin
GROUP BY bins.bin, lo, hi""")
def histogram(spark, sf):
    h = profile.histogram(io.scan(spark, sf, "lineitem"), "l_extendedprice", 10)
    return h.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "count")


@register("profile_cache", "P10", """
WITH p AS (SELECT table_id, max(completed_at) AS profiled_at FROM sync_jobs WHERE status = 'completed' GROUP BY table_id)
SELECT m.table_id, m.last_updated, p.profiled_at,
  CASE WHEN p.profiled_at IS NULL OR m.last_updated IS NULL OR p.profiled_at < m.last_updated THEN 'refresh' ELSE 'reuse' END AS action
FROM table_metadata m LEFT JOIN p ON m.table_id = p.table_id""", fixtures=["sync_jobs", "table_metadata"])
def profile_cache(spark, sf):
    t = Tables(spark, sf)
    profiles = (t["sync_jobs"].where(F.col("status") == "completed")
                .select("table_id", F.col("completed_at").alias("profiled_at")))
    return profile.profile_cache(profiles, t["table_metadata"], force_refresh=False)


def _profiled(spark, sf):
    """A replica of events after a full copy and two incremental syncs, each profiled when it came."""
    from cairn.operators import sync
    from cairn.operators.profilestore import ProfileStore
    from cairn.session import work_dir
    rep = sync.Replica(spark, work_dir(spark, "profiled"), "events")
    events = io.scan(spark, sf, "events")
    store = ProfileStore(rep)
    for day, job in (("10", "jprof001"), ("20", "jprof002"), ("31", "jprof003")):
        sync.sync_incremental(rep, events.where(F.col("ts") < F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")), "ts", job)
        store.refresh()
    return rep, store


def _states_oracle():
    numbers = {"event_id": "event_id", "user_id": "user_id", "value": "value", "ts": "epoch_us(ts)"}
    rows = []
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props"):
        stats = (f"avg({numbers[c]}::DOUBLE), stddev_samp({numbers[c]}::DOUBLE), min({numbers[c]})::DOUBLE, max({numbers[c]})::DOUBLE, NULL, NULL"
                 if c in numbers else f"NULL, NULL, NULL, NULL, min({c}), max({c})")
        rows.append(f"SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS null_count, {stats}, true, true FROM events WHERE ts < TIMESTAMP '2024-01-31'")
    return ("SELECT column_name, count, null_count, format('{:.8e}', mean) AS mean, format('{:.8e}', std) AS std, min, max, min_text, max_text, unique_near, median_near FROM ("
            + " UNION ALL ".join(rows) + ") AS t(column_name, count, null_count, mean, std, min, max, min_text, max_text, unique_near, median_near)")


@register("profile_states", "P10", _states_oracle())
def profile_states(spark, sf):
    """The profile merged from three batches' states: exact numbers, and whether distinct counts lie within 4 % and medians
    within 1 % of the ranks of the whole replica."""
    rep, store = _profiled(spark, sf)
    report = store.report()
    whole = rep.read()
    numbers = ["event_id", "user_id", "value", "ts"]
    mids = {r.column_name: r.p50 for r in report.where(F.col("column_name").isin(numbers)).select("column_name", "p50").collect()}
    as_number = {c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if c == "ts" else F.col(c).cast("double") for c in numbers}
    seen = whole.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in whole.columns], F.count(F.lit(1)).alias("n"),
                     *[F.count_if(as_number[c] < mids[c]).alias(f"below_{c}") for c in numbers],
                     *[F.count_if(as_number[c] <= mids[c]).alias(f"upto_{c}") for c in numbers]).first()
    near = [(c, float(seen[f"d_{c}"]), c not in mids or seen[f"below_{c}"] <= 0.51 * seen["n"] and seen[f"upto_{c}"] >= 0.49 * seen["n"]) for c in whole.columns]
    exact = spark.createDataFrame(near, "column_name string, exact double, median_near boolean")
    nine = {c: F.when(F.col(c).isNotNull(), F.format_string("%.8e", c)).alias(c) for c in ("mean", "std")}
    return report.join(exact, "column_name").select(
        "column_name", "count", "null_count", nine["mean"], nine["std"], "min", "max", "min_text", "max_text",
        (F.abs(F.col("approx_unique") - F.col("exact")) <= 0.04 * F.col("exact")).alias("unique_near"), "median_near")


@register("profile_state_batches", "P10", """
SELECT 'jprof001' AS job_id, count_if(ts < TIMESTAMP '2024-01-10') AS rows FROM events
UNION ALL SELECT 'jprof002', count_if(ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') FROM events
UNION ALL SELECT 'jprof003', count_if(ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-31') FROM events""")
def profile_state_batches(spark, sf):
    """What the refreshes read: each batch once, alone."""
    _, store = _profiled(spark, sf)
    store.refresh()
    return spark.createDataFrame([(e["job_id"], e["rows"]) for e in store.commits.entries()], "job_id string, rows bigint")


_TEXT_COLUMNS = {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "part": "'p' || l_partkey % 60", "line": "l_orderkey || '-' || l_linenumber"}


@register("profile_text_sketch", "P6", "\nUNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS column_name, sum(n)::BIGINT AS count, max(n) AS freq, arg_min(v, (-n, v)) AS top, true AS unique_near
  FROM (SELECT {e} AS v, count(*) AS n FROM lineitem GROUP BY ALL))""" for c, e in _TEXT_COLUMNS.items()))
def profile_text_sketch(spark, sf):
    """Text columns by sketches: few values, one value in sixty, and all values different (which goes the exact way)."""
    lines = Tables(spark, sf).given("lineitem")
    df = lines.select("l_returnflag", "l_linestatus", F.concat(F.lit("p"), F.col("l_partkey") % 60).alias("part"),
                      F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    near = spark.createDataFrame(list(exact.items()), "column_name string, exact bigint")
    return profile.profile_text_sketch(df).join(near, "column_name").select(
        "column_name", "count", "freq", "top", (F.abs(F.col("approx_unique") - F.col("exact")) <= 0.04 * F.col("exact")).alias("unique_near"))
