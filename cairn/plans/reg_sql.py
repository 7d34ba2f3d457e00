"""Registered queries: SQL jobs (Q1-Q6) and the pass-through coverage suite.

The coverage texts run in Spark (through ``run_sql`` over the allowed views)
and in DuckDB, so each is its own oracle; where the two dialects spell a
function differently (JSON, arrays, timestamp types), the Spark text swaps
that spelling and nothing else.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import sqljobs
from cairn.plans.fixtures import GIVEN_TABLES, Tables
from cairn.plans.registry import register
from cairn.session import work_dir

# Pass-through coverage: one SQL text per class of the survey's table.
COVERAGE = {
    "sql_filter_case": """
SELECT l_orderkey, l_linenumber, l_quantity,
  CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'mid' ELSE 'low' END AS discount_band
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20""",
    "sql_join_revenue": """
SELECT n.n_name, count(DISTINCT c.c_custkey) AS customers, count(*) AS orders,
  round(sum(o.o_totalprice), 2) AS revenue
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name""",
    "sql_left_join": """
SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS orders
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name""",
    "sql_semi_anti": """
SELECT 'with_orders' AS kind, count(*) AS customers FROM customer c
  WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
UNION ALL
SELECT 'without_orders', count(*) FROM customer c
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""",
    "sql_range_join": """
WITH days AS (
  SELECT CAST(ts AS DATE) AS d, count(*) AS events FROM events GROUP BY CAST(ts AS DATE))
SELECT a.d, CAST(sum(b.events) AS BIGINT) AS events_3d FROM days a JOIN days b
  ON b.d BETWEEN a.d - INTERVAL '2' DAY AND a.d GROUP BY a.d""",
    "sql_distinct_agg": """
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(avg(value), 6) AS avg_value
FROM events GROUP BY event_type""",
    "sql_rollup": """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_window": """
SELECT o_custkey, o_orderkey, o_totalprice,
  CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS price_rank,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total
FROM orders""",
    "sql_topk": """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
    "sql_setops": """
SELECT 'both' AS kind, count(*) AS nations FROM (
  SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL
SELECT 'customer_only', count(*) FROM (
  SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL
SELECT 'any', count(*) FROM (
  SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""",
    "sql_scalars": """
SELECT event_id, upper(substr(event_type, 1, 3)) AS type3, date_trunc('day', ts) AS day,
  value * 1.5 AS scaled, json_extract_string(props, '$.k') AS prop_k,
  CAST(length(props) AS BIGINT) AS props_len,
  CAST(len(string_split(event_type || '_' || CAST(user_id AS VARCHAR), '_')) AS BIGINT) AS n_parts,
  list_sort([event_type, CAST(user_id AS VARCHAR)])[1] AS first_sorted
FROM events""",
    "sql_subquery": """
WITH cust_avg AS (SELECT o_custkey, avg(o_totalprice) AS avg_price FROM orders GROUP BY o_custkey)
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o
WHERE o.o_totalprice > (SELECT a.avg_price FROM cust_avg a WHERE a.o_custkey = o.o_custkey)""",
}

# Spark spellings where the two dialects differ in a function name only.
_SPARK_TEXT = {
    "sql_scalars": COVERAGE["sql_scalars"].replace("json_extract_string(props, '$.k')",
                                                   "get_json_object(props, '$.k')")
                                          .replace("date_trunc('day', ts)",
                                                   "CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ)")
                                          .replace("len(string_split(event_type || '_' || CAST(user_id AS VARCHAR), '_'))",
                                                   "size(split(concat(event_type, '_', CAST(user_id AS STRING)), '_'))")
                                          .replace("list_sort([event_type, CAST(user_id AS VARCHAR)])[1]",
                                                   "element_at(array_sort(array(event_type, CAST(user_id AS STRING))), 1)"),
}


# Spark joins a subquery that it can't prove to give one row (here: one behind a common table expression) as a single
# join, for which it has a hash join by broadcast or a nested loop, and no other.  By estimates it takes the nested loop for all
# but small tables; with this, by the rows there are (one per customer), it takes the hash join up to this size of them.
_SETTINGS = {"sql_subquery": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.autoBroadcastJoinThreshold": "512m"}}


def _allowed(spark, sf, key=None):
    """A session that holds the given tables as views and nothing else, made once per caller and folder (and for a
    query with settings)."""
    root, settings = sf.rstrip("/"), _SETTINGS.get(key)
    made = spark.__dict__.setdefault("_cairn_allowed", {})
    name = (root, key) if settings else root
    if name not in made:
        made[name] = sqljobs.allowed_session(spark, {n: f"{root}/{n}.parquet" for n in GIVEN_TABLES}, settings=settings)
    return made[name]


def _coverage_fn(key):
    def fn(spark, sf):
        return sqljobs.run_sql(_allowed(spark, sf, key), _SPARK_TEXT.get(key, COVERAGE[key]))
    fn.__name__ = key
    return fn


for _k, _text in COVERAGE.items():
    register(_k, "Q1", _text)(_coverage_fn(_k))


_EVENTS_BY_TYPE = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"


@register("adhoc_sql", "Q1", """
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def adhoc_sql(spark, sf):
    return sqljobs.run_sql(_allowed(spark, sf), "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users "
                                  "FROM events GROUP BY event_type")


@register("sql_params", "Q2", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE event_type = 'click' AND value > 10 GROUP BY event_type""")
def sql_params(spark, sf):
    return sqljobs.run_sql(
        _allowed(spark, sf), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events "
               "WHERE event_type = :etype AND value > :minv GROUP BY event_type",
        args={"etype": "click", "minv": 10})


@register("sql_max_rows", "Q3", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sql_max_rows(spark, sf):
    return sqljobs.run_sql(_allowed(spark, sf), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey", max_rows=50)


@register("query_job_status", "Q4", """
SELECT job_id, status, error, result_path, row_count, created_at, started_at, completed_at
FROM query_jobs WHERE status <> 'completed'""", fixtures=["query_jobs"])
def query_job_status(spark, sf):
    t = Tables(spark, sf)
    jobs = t["query_jobs"]
    polled = jobs.where(F.col("status") != "completed").select("job_id")
    return sqljobs.query_job_status(jobs, polled)


@register("run_query_job", "Q5", """
SELECT 'qevents01' AS job_id, 'completed' AS status, CAST(NULL AS VARCHAR) AS error, 'csv' AS format,
  (SELECT count(DISTINCT event_type) FROM events) AS row_count, CAST(2 AS BIGINT) AS column_count
UNION ALL
SELECT 'qbroken01', 'failed', 'TABLE_OR_VIEW_NOT_FOUND', 'csv', NULL, NULL""")
def run_query_job(spark, sf):
    spark = _allowed(spark, sf)
    ok = sqljobs.run_query_job(spark, "qevents01", _EVENTS_BY_TYPE, "csv", work_dir(spark, "qjob"))
    bad = sqljobs.run_query_job(spark, "qbroken01", "SELECT * FROM table_that_is_not_allowed", "csv",
                                work_dir(spark, "qjob"))
    both = ok.unionByName(bad)
    return both.select("job_id", "status",
                       F.regexp_extract("error", r"\[([A-Z_]+)\]", 1).alias("error_class"),
                       "format", "row_count", "column_count").withColumnRenamed("error_class", "error") \
        .withColumn("error", F.when(F.col("error") == "", None).otherwise(F.col("error")))


@register("query_result", "Q6", _EVENTS_BY_TYPE)
def query_result(spark, sf):
    spark = _allowed(spark, sf)
    job = sqljobs.run_query_job(spark, "qevents02", _EVENTS_BY_TYPE, "parquet", work_dir(spark, "qjob")).first()
    return sqljobs.query_result(spark, job.asDict())


#: Texts that a job may not run, and what its error must name.
_REFUSED = {
    "qallow02": ("SELECT count(*) AS n FROM orders", "orders"),
    "qallow03": ("CREATE TEMPORARY VIEW v AS SELECT 1 AS n", "not a query"),
    "qallow04": ("SELECT count(*) AS n FROM parquet.`{root}/orders.parquet`", "parquet"),
    "qallow05": ("SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS n", "function reflect"),
    "qallow06": ("SELECT n FROM (SELECT java_method('java.lang.System', 'lineSeparator') AS n)", "function java_method"),
    "qallow07": ("WITH a AS (SELECT try_reflect('java.lang.System', 'nanoTime') AS n) SELECT * FROM a", "function try_reflect"),
    "qallow08": ("SELECT * FROM global_temp.cairn_secret", "global_temp.cairn_secret"),
    "qallow09": ("SELECT * FROM events WHERE event_id IN (SELECT n FROM global_temp.cairn_secret)", "global_temp.cairn_secret"),
    "qallow10": ("SELECT TRANSFORM(event_id) USING 'cat' AS (n) FROM events", "ScriptTransformation"),
    "qallow11": ("SELECT * FROM IDENTIFIER('global_temp.' || 'cairn_secret')", "names made by an expression"),
    "qallow12": ("SELECT input_file_name() AS n FROM events", "function input_file_name"),
}


@register("sql_allow_list", "Q1", "SELECT 'qallow01' AS job_id, 'completed' AS status, (SELECT count(*) FROM events) AS n, CAST(NULL AS VARCHAR) AS refused"
          + "".join(f"\nUNION ALL SELECT '{k}', 'failed', NULL, '{told}'" for k, (_, told) in _REFUSED.items()))
def sql_allow_list(spark, sf):
    """Jobs in a session that holds the catalog's active tables only: an active
    table is read; an inactive one, commands, files, calls into the JVM, another session's views, scripts and made-up names are refused."""
    root = sf.rstrip("/")
    spark.read.parquet(f"{root}/orders.parquet").createOrReplaceTempView("orders")
    spark.sql("SELECT 1 AS n").createOrReplaceGlobalTempView("cairn_secret")
    catalog = spark.createDataFrame([("events", "active"), ("orders", "inactive")], "table_name string, status string")
    own = sqljobs.allowed_session(spark, {n: f"{root}/{n}.parquet" for n in GIVEN_TABLES}, catalog)
    texts = {"qallow01": ("SELECT count(*) AS n FROM events", None), **_REFUSED}
    rows = []
    for job_id, (text, told) in texts.items():
        job = sqljobs.run_query_job(own, job_id, text.replace("{root}", root), "parquet", work_dir(spark, "qjob")).first()
        n = sqljobs.query_result(own, job.asDict()).first()["n"] if job["status"] == "completed" else None
        rows.append((job_id, job["status"], n, told if told and told in job["error"] else job["error"]))
    return spark.createDataFrame(rows, "job_id string, status string, n bigint, refused string")
