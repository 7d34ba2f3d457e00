"""Registered queries: column policies."""

from __future__ import annotations

from cairn.operators import governance
from cairn.plans.fixtures import Tables
from cairn.plans.registry import register


@register("restrict_columns", "G1", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def restrict_columns(spark, sf):
    t = Tables(spark, sf)
    return governance.restrict_columns(t["customer"], t["column_policies"], "customer")


@register("mask_columns", "G2", """
SELECT sha256(CAST(c_custkey AS VARCHAR)) AS c_custkey,
  repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS c_name, c_nationkey, c_mktsegment
FROM customer""")
def mask_columns(spark, sf):
    t = Tables(spark, sf)
    return governance.mask_columns(t["customer"], t["column_policies"], "customer")
