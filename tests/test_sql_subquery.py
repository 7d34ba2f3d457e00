"""The correlated subquery on tables that Spark thinks too large to broadcast."""

from cairn.plans import reg_sql
from cairn.plans.fixtures import GIVEN_TABLES


def test_a_large_table_needs_no_nested_loop(spark, tmp_path):
    rows = spark.range(20000).selectExpr("id AS o_orderkey", "if(id % 97 = 0, null, id % 500) AS o_custkey",
                                         "cast((id * 7919) % 1000 AS double) AS o_totalprice")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    for name in GIVEN_TABLES:
        if name != "orders":
            spark.range(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    own = reg_sql._allowed(spark, str(tmp_path), "sql_subquery")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table: not by its estimate
    got = reg_sql._coverage_fn("sql_subquery")(spark, str(tmp_path))
    found = sorted(r.o_orderkey for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("== Initial Plan ==")[0] and "NestedLoop" not in plan.split("== Initial Plan ==")[0]
    data = [r for r in rows.collect() if r.o_custkey is not None]
    sums = {}
    for r in data:
        n, total = sums.get(r.o_custkey, (0, 0.0))
        sums[r.o_custkey] = n + 1, total + r.o_totalprice
    assert found == sorted(r.o_orderkey for r in data if r.o_totalprice > sums[r.o_custkey][1] / sums[r.o_custkey][0])
