"""What a query job may and may not touch."""

import pytest

from cairn.operators import sqljobs
from cairn.operators.sqlguard import Guard
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def own(spark):
    spark.sql("SELECT 7 AS n").createOrReplaceGlobalTempView("guard_secret")
    spark.sql("SELECT 7 AS n").createOrReplaceTempView("guard_other")
    spark.udf.register("guard_udf", lambda x: x)
    return sqljobs.allowed_session(spark, {n: f"{SF_SMALL}/{n}.parquet" for n in ("events", "nation")})


ALLOWED = [
    "SELECT upper(n_name) FROM nation WHERE n_nationkey IN (SELECT user_id % 25 FROM events)",
    "WITH a AS (SELECT * FROM nation), b AS (SELECT count(*) AS n FROM a) SELECT a.*, b.n FROM a, b",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r",
    "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y) ORDER BY x LIMIT 1",
    "SELECT id FROM range(5)",
    "SELECT event_type, k FROM events LATERAL VIEW explode(array(1, 2)) t AS k",
    "SELECT n.n_name, t.c FROM nation n, LATERAL (SELECT count(*) AS c FROM events e WHERE e.user_id = n.n_nationkey) t",
    "SELECT * FROM (SELECT event_type, user_id FROM events) PIVOT (count(user_id) FOR event_type IN ('click', 'view'))",
    "SELECT event_type, rank() OVER (ORDER BY ts) AS r, (SELECT max(value) FROM events) AS m FROM events TABLESAMPLE (50 PERCENT)",
    "SELECT n_nationkey FROM nation EXCEPT SELECT user_id FROM events",
    "SELECT transform(array(1, 2), x -> x + 1) AS a, 1 AS reflect",
    "FROM events |> WHERE value > 1 |> SELECT event_type",
]

REFUSED = [
    ("SELECT * FROM guard_other", "guard_other"),
    ("SELECT * FROM global_temp.guard_secret", "guard_secret"),
    ("SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM global_temp.guard_secret)", "guard_secret"),
    ("SELECT (SELECT max(n) FROM global_temp.guard_secret) AS n", "guard_secret"),
    ("SELECT reflect('java.lang.System', 'nanoTime')", "reflect"),
    ("SELECT array_sort(array(1), (a, b) -> int(REFLECT('java.lang.Math', 'abs', a)))", "reflect"),
    ("SELECT * FROM nation ORDER BY java_method('java.lang.System', 'nanoTime')", "java_method"),
    ("SELECT count(*) FILTER (WHERE try_reflect('java.lang.System', 'nanoTime') = '1') FROM nation", "try_reflect"),
    ("SELECT * FROM VALUES (reflect('java.lang.System', 'nanoTime')) AS t(x)", "reflect"),
    ("SELECT * FROM range(length(reflect('java.lang.System', 'nanoTime')))", "reflect"),
    ("SELECT system.builtin.reflect('java.lang.System', 'nanoTime')", "reflect"),
    ("SELECT guard_udf(1)", "guard_udf"),
    ("SELECT * FROM read_files('/etc')", "read_files"),
    ("SELECT * FROM parquet.`/tmp`", "parquet"),
    ("SELECT * FROM spark_catalog.default.t", "spark_catalog"),
    ("SELECT IDENTIFIER('reflect')('java.lang.System', 'nanoTime')", "made by an expression"),
    ("SELECT TRANSFORM(n_name) USING 'cat' AS (a) FROM nation", "ScriptTransformation"),
    ("DROP VIEW nation", "not a query"),
    ("SET spark.sql.runSQLOnFiles=true", "not a query"),
    ("SHOW TABLES", "not a query"),
    ("CLEAR CACHE", "not a query"),
    ("RESET", "not a query"),
    ("SELECT 1) UNION (SELECT 2", ""),
    ("SELECT 1; DROP VIEW nation", "not a query"),
]


@pytest.mark.parametrize("text", ALLOWED)
def test_queries_run(own, text):
    Guard(own).run(text).collect()


@pytest.mark.parametrize("text,told", REFUSED)
def test_refused(own, text, told):
    if not told:
        # Two halves that only fit inside the check's brackets are still a query over nothing.
        with pytest.raises(Exception):
            Guard(own).run(text)
        return
    with pytest.raises(Exception) as e:
        Guard(own).run(text)
    assert told in str(e.value)
    job = sqljobs.run_query_job(own, "q", text, "parquet", "/nowhere").first()
    assert job.status == "failed" and told in job.error


def test_parameters_and_a_view_that_reads_files(own):
    assert sqljobs.run_sql(own, "SELECT count(*) AS n FROM events WHERE user_id = :u", {"u": 1}, max_rows=1).first().n > 0
