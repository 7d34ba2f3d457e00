"""Registered queries: catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import catalog
from cairn.plans.fixtures import GIVEN_TABLES, Tables
from cairn.plans.registry import register

_CATALOG_CTES = """
WITH a AS (
  SELECT r.*, EXISTS (SELECT 1 FROM source_tables s
                      WHERE s.schema_name = r.schema_name AND s.table_name = r.table_name) AS in_src
  FROM registry_actions r),
v AS (SELECT *, row_number() OVER (PARTITION BY schema_name, table_name ORDER BY ts, action_id) AS rn
      FROM a WHERE in_src),
fa AS (SELECT schema_name, table_name, min(rn) AS first_rn FROM v WHERE action = 'add'
       GROUP BY schema_name, table_name),
valid AS (SELECT v.*, fa.first_rn FROM v JOIN fa USING (schema_name, table_name) WHERE rn >= first_rn),
lagged AS (SELECT *, lag(action) OVER (PARTITION BY schema_name, table_name ORDER BY rn) AS prev FROM valid),
act AS (SELECT schema_name, table_name, max(rn) AS act_rn FROM lagged
        WHERE action = 'add' AND (prev IS NULL OR prev = 'remove') GROUP BY schema_name, table_name),
fin AS (SELECT schema_name, table_name, max(rn) AS last_rn FROM valid GROUP BY schema_name, table_name)"""


@register("catalog_state", "C1", _CATALOG_CTES + """
SELECT f.schema_name, f.table_name, 't' || CAST(first_v.action_id AS VARCHAR) AS table_id,
  CASE WHEN last_v.action = 'add' THEN 'active' ELSE 'inactive' END AS status, act_v.ts AS created_at
FROM fin f
JOIN fa USING (schema_name, table_name)
JOIN act USING (schema_name, table_name)
JOIN valid first_v ON first_v.schema_name = f.schema_name AND first_v.table_name = f.table_name AND first_v.rn = fa.first_rn
JOIN valid last_v ON last_v.schema_name = f.schema_name AND last_v.table_name = f.table_name AND last_v.rn = f.last_rn
JOIN valid act_v ON act_v.schema_name = f.schema_name AND act_v.table_name = f.table_name AND act_v.rn = act.act_rn""",
          fixtures=["registry_actions", "source_tables"])
def catalog_state(spark, sf):
    t = Tables(spark, sf)
    return catalog.catalog_state(t["registry_actions"], t["source_tables"])[0]


@register("catalog_errors", "C1", """
WITH a AS (
  SELECT r.*, EXISTS (SELECT 1 FROM source_tables s
                      WHERE s.schema_name = r.schema_name AND s.table_name = r.table_name) AS in_src
  FROM registry_actions r),
fa AS (SELECT schema_name, table_name, min(ts) AS t0 FROM registry_actions WHERE action = 'add'
       GROUP BY schema_name, table_name)
SELECT a.action_id, a.schema_name, a.table_name, a.action, a.ts,
  CASE WHEN a.action = 'add' AND NOT a.in_src THEN 'table not found in source' ELSE 'table not in catalog' END AS error
FROM a LEFT JOIN fa USING (schema_name, table_name)
WHERE NOT a.in_src OR fa.t0 IS NULL
   OR NOT EXISTS (SELECT 1 FROM registry_actions b WHERE b.schema_name = a.schema_name AND b.table_name = a.table_name
                  AND b.action = 'add' AND (b.ts < a.ts OR (b.ts = a.ts AND b.action_id <= a.action_id)))""",
          fixtures=["registry_actions", "source_tables"])
def catalog_errors(spark, sf):
    t = Tables(spark, sf)
    return catalog.catalog_state(t["registry_actions"], t["source_tables"])[1]


def _state(t):
    return {n: t[n] for n in ("allowed_tables", "sync_jobs", "table_tags", "table_metadata")}


def _removed_ids(t):
    """The tables of schema s1 (one region's nations) are removed."""
    return t["allowed_tables"].where(F.col("schema_name") == "s1").select("table_id")


@register("catalog_remove_soft", "C2", """
SELECT table_id, table_name, schema_name, source,
  CASE WHEN schema_name = 's1' THEN 'inactive' ELSE status END AS status, created_at FROM allowed_tables""",
          fixtures=["allowed_tables"])
def catalog_remove_soft(spark, sf):
    t = Tables(spark, sf)
    return catalog.catalog_remove(_state(t), _removed_ids(t), hard=False)["allowed_tables"]


@register("catalog_remove_hard", "C2", """
WITH gone AS (SELECT table_id FROM allowed_tables WHERE schema_name = 's1')
SELECT 'allowed_tables' AS state_table, count(*) AS row_count FROM allowed_tables WHERE table_id NOT IN (SELECT table_id FROM gone)
UNION ALL SELECT 'sync_jobs', count(*) FROM sync_jobs WHERE table_id NOT IN (SELECT table_id FROM gone)
UNION ALL SELECT 'table_tags', count(*) FROM table_tags WHERE table_id NOT IN (SELECT table_id FROM gone)
UNION ALL SELECT 'table_metadata', count(*) FROM table_metadata WHERE table_id NOT IN (SELECT table_id FROM gone)""",
          fixtures=["allowed_tables", "sync_jobs", "table_tags", "table_metadata"])
def catalog_remove_hard(spark, sf):
    t = Tables(spark, sf)
    out = catalog.catalog_remove(_state(t), _removed_ids(t), hard=True)
    parts = [out[n].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("state_table"), "row_count")
             for n in ("allowed_tables", "sync_jobs", "table_tags", "table_metadata")]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@register("allowed_only", "C3", """
SELECT j.* FROM sync_jobs j WHERE EXISTS (SELECT 1 FROM allowed_tables a WHERE a.table_id = j.table_id AND a.status = 'active')""",
          fixtures=["sync_jobs", "allowed_tables"])
def allowed_only(spark, sf):
    t = Tables(spark, sf)
    return catalog.allowed_only(t["sync_jobs"], t["allowed_tables"])


@register("list_allowed", "C4", "SELECT table_id, schema_name, table_name, source, status, created_at FROM allowed_tables",
          fixtures=["allowed_tables"])
def list_allowed(spark, sf):
    return catalog.list_allowed(Tables(spark, sf)["allowed_tables"])


def _tags_as_text(df):
    """Tag lists as sorted comma-joined text for the comparison with the
    oracle (list values compare differently across engines' client types)."""
    return df.withColumn("tags", F.array_join("tags", ","))


_META = """
SELECT a.table_id, a.table_name, a.schema_name, a.source, coalesce(m.column_count, 0) AS column_count,
  CAST(coalesce(m.row_count, 0) AS BIGINT) AS row_count, CAST(coalesce(m.size_bytes, 0) AS BIGINT) AS size_bytes,
  m.last_updated, m.description, array_to_string(coalesce(g.tags, CAST([] AS VARCHAR[])), ',') AS tags
FROM allowed_tables a LEFT JOIN table_metadata m ON a.table_id = m.table_id
LEFT JOIN (SELECT table_id, list_sort(list_distinct(list(tag))) AS tags FROM table_tags GROUP BY table_id) g
  ON a.table_id = g.table_id
WHERE a.status = 'active'"""


@register("table_metadata", "C5", _META, fixtures=["allowed_tables", "table_metadata", "table_tags"])
def table_metadata(spark, sf):
    t = Tables(spark, sf)
    return _tags_as_text(catalog.table_metadata(t["allowed_tables"], t["table_metadata"], t["table_tags"]))


@register("schema_inventory", "C6", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in GIVEN_TABLES))
def schema_inventory(spark, sf):
    return catalog.schema_inventory(spark, sf, GIVEN_TABLES).select("table_name", "row_count")


@register("find_by_tag", "C7", """
SELECT a.* FROM allowed_tables a WHERE a.status = 'active' AND (
  EXISTS (SELECT 1 FROM table_tags g WHERE g.table_id = a.table_id AND g.tag IN ('monthly'))
  OR EXISTS (SELECT 1 FROM table_metadata m WHERE m.table_id = a.table_id AND contains(lower(m.description), 'user 7')))""",
          fixtures=["allowed_tables", "table_tags", "table_metadata"])
def find_by_tag(spark, sf):
    t = Tables(spark, sf)
    return catalog.find_by_tag(t["allowed_tables"], t["table_tags"], t["table_metadata"], ["monthly"], "User 7")


@register("list_data", "C8", _META + "\nORDER BY a.schema_name, a.table_name",
          fixtures=["allowed_tables", "table_metadata", "table_tags"])
def list_data(spark, sf):
    t = Tables(spark, sf)
    return _tags_as_text(catalog.list_data(t["allowed_tables"], t["table_metadata"], t["table_tags"]))
