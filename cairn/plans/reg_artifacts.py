"""Registered queries: artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import artifacts as art
from cairn.plans.fixtures import ARTIFACT_CLOCK, Tables
from cairn.plans.registry import register

NOW = f"TIMESTAMP '{ARTIFACT_CLOCK}'"
A_COLS = ("artifact_id, name, type, format, size_bytes, storage_path, created_at, expires_at, "
          "metadata, swarm_token")

# Strict base64 in SQL: alphabet, padding only at the end, length divisible by 4.
_VALID_B64 = "(regexp_full_match(content, '[A-Za-z0-9+/]*={0,2}') AND length(content) % 4 = 0)"
_REASON = f"""CASE WHEN name IS NULL OR length(name) < 1 OR length(name) > 255 THEN 'invalid name'
  WHEN type IS NULL OR type NOT IN ('data', 'model', 'report', 'other') THEN 'invalid type'
  WHEN format IS NULL OR format NOT IN ('json', 'csv', 'parquet', 'pickle', 'text', 'binary') THEN 'invalid format'
  WHEN expiry_days <= 0 THEN 'invalid expiry_days'
  WHEN NOT {_VALID_B64} THEN 'invalid base64'
  WHEN length(content) / 4 * 3 - (length(content) - length(rtrim(content, '='))) > 52428800 THEN 'too large' END"""


@register("artifact_ingest", "A1", f"""
SELECT 'a' || lpad(CAST(upload_id AS VARCHAR), 8, '0') AS artifact_id, name, type, format,
  CAST(length(content) / 4 * 3 - (length(content) - length(rtrim(content, '='))) AS BIGINT) AS size_bytes,
  'artifacts/a' || lpad(CAST(upload_id AS VARCHAR), 8, '0') || '.' || format AS storage_path,
  {NOW} AS created_at, {NOW} + coalesce(expiry_days, 10) * INTERVAL '1' DAY AS expires_at,
  coalesce(metadata, '{{}}') AS metadata, swarm_token, sha256(from_base64(content)) AS content_sha256
FROM artifact_uploads WHERE ({_REASON}) IS NULL""", fixtures=["artifact_uploads"])
def artifact_ingest(spark, sf):
    acc, _, _ = art.ingest(Tables(spark, sf)["artifact_uploads"], ARTIFACT_CLOCK)
    return acc.withColumn("content_sha256", F.sha2("content", 256)).drop("content")


@register("artifact_ingest_tags", "A1", f"""
SELECT DISTINCT 'a' || lpad(CAST(upload_id AS VARCHAR), 8, '0') AS artifact_id, unnest(tags) AS tag
FROM artifact_uploads WHERE ({_REASON}) IS NULL""", fixtures=["artifact_uploads"])
def artifact_ingest_tags(spark, sf):
    return art.ingest(Tables(spark, sf)["artifact_uploads"], ARTIFACT_CLOCK)[1]


@register("artifact_rejected", "A1", f"""
SELECT upload_id, {_REASON} AS reason FROM artifact_uploads WHERE ({_REASON}) IS NOT NULL""",
          fixtures=["artifact_uploads"])
def artifact_rejected(spark, sf):
    return art.ingest(Tables(spark, sf)["artifact_uploads"], ARTIFACT_CLOCK)[2]


_TAGLIST = ("(SELECT artifact_id, list_sort(list_distinct(list(tag))) AS tags FROM artifact_tags "
            "GROUP BY artifact_id)")

_INFO = f"""
SELECT a.artifact_id, a.name, a.type, a.format, a.size_bytes, a.created_at, a.expires_at, a.swarm_token,
  json_extract_string(a.metadata, '$.lang') AS meta_lang, json_extract_string(a.metadata, '$.src') AS meta_src,
  array_to_string(coalesce(g.tags, CAST([] AS VARCHAR[])), ',') AS tags
FROM artifacts a LEFT JOIN {_TAGLIST} g ON a.artifact_id = g.artifact_id"""


def _info_cols(df):
    return df.select("artifact_id", "name", "type", "format", "size_bytes", "created_at", "expires_at",
                     "swarm_token", F.element_at("metadata", F.lit("lang")).alias("meta_lang"),
                     F.element_at("metadata", F.lit("src")).alias("meta_src"),
                     F.array_join("tags", ",").alias("tags"))


@register("artifact_info", "A2", _INFO + "\nWHERE a.swarm_token = 'swarm1'", fixtures=["artifacts", "artifact_tags"])
def artifact_info(spark, sf):
    t = Tables(spark, sf)
    return _info_cols(art.artifact_info(t["artifacts"], t["artifact_tags"], "swarm1"))


@register("artifact_list", "A3", _INFO + """
WHERE a.swarm_token = 'swarm0' AND a.format = 'json' AND a.created_at >= TIMESTAMP '2024-01-05 00:00:00'
  AND a.created_at <= TIMESTAMP '2024-01-25 00:00:00' AND a.size_bytes >= 0 AND a.size_bytes <= 50000
ORDER BY a.created_at DESC, a.artifact_id""", fixtures=["artifacts", "artifact_tags"])
def artifact_list(spark, sf):
    t = Tables(spark, sf)
    return _info_cols(art.list_artifacts(t["artifacts"], t["artifact_tags"], "swarm0", format="json",
                                         created_after="2024-01-05 00:00:00",
                                         created_before="2024-01-25 00:00:00", min_size=0, max_size=50000))


@register("artifact_all_tags", "A4", _INFO + """
WHERE a.swarm_token = 'swarm0'
  AND EXISTS (SELECT 1 FROM artifact_tags x WHERE x.artifact_id = a.artifact_id AND x.tag = 'even')
  AND EXISTS (SELECT 1 FROM artifact_tags x WHERE x.artifact_id = a.artifact_id AND x.tag = 'third')
ORDER BY a.created_at DESC, a.artifact_id""", fixtures=["artifacts", "artifact_tags"])
def artifact_all_tags(spark, sf):
    t = Tables(spark, sf)
    return _info_cols(art.list_artifacts(t["artifacts"], t["artifact_tags"], "swarm0", tags_all=["even", "third"]))


_OWNED_PATCH = ("(SELECT p.* FROM artifact_patches p JOIN artifacts x ON p.artifact_id = x.artifact_id "
                "AND p.swarm_token = x.swarm_token)")


# The owner's valid patches folded in order: per field the last value given.
_FOLDED_PATCH = f"""(SELECT artifact_id, arg_max(name, patch_seq) FILTER (WHERE name IS NOT NULL) AS name,
  arg_max(metadata, patch_seq) FILTER (WHERE metadata IS NOT NULL) AS metadata,
  arg_max(expiry_days, patch_seq) FILTER (WHERE expiry_days IS NOT NULL) AS expiry_days,
  arg_max(tags, patch_seq) FILTER (WHERE tags IS NOT NULL) AS tags
  FROM {_OWNED_PATCH} WHERE expiry_days IS NULL OR expiry_days > 0 GROUP BY artifact_id)"""


_UPDATED = f"""
SELECT a.artifact_id, coalesce(p.name, a.name) AS name, a.type, a.format, a.size_bytes, a.storage_path,
  a.created_at, CASE WHEN p.expiry_days IS NOT NULL THEN {NOW} + p.expiry_days * INTERVAL '1' DAY ELSE a.expires_at END
    AS expires_at, coalesce(p.metadata, a.metadata) AS metadata, a.swarm_token
FROM artifacts a LEFT JOIN {_FOLDED_PATCH} p ON a.artifact_id = p.artifact_id"""


@register("artifact_update", "A5", _UPDATED, fixtures=["artifacts", "artifact_patches"])
def artifact_update(spark, sf):
    t = Tables(spark, sf)
    return art.update(t["artifacts"], t["artifact_patches"], ARTIFACT_CLOCK)


@register("artifact_replace_tags", "A6", f"""
WITH p AS (SELECT * FROM {_FOLDED_PATCH} WHERE tags IS NOT NULL)
SELECT artifact_id, tag FROM artifact_tags WHERE artifact_id NOT IN (SELECT artifact_id FROM p)
UNION ALL
SELECT DISTINCT artifact_id, unnest(tags) AS tag FROM p""", fixtures=["artifacts", "artifact_tags", "artifact_patches"])
def artifact_replace_tags(spark, sf):
    t = Tables(spark, sf)
    return art.replace_tags(t["artifact_tags"], t["artifact_patches"], t["artifacts"])


@register("artifact_delete", "A7", f"""
SELECT a.artifact_id, a.storage_path FROM artifacts a
WHERE a.artifact_id IN (SELECT artifact_id FROM {_OWNED_PATCH})""", fixtures=["artifacts", "artifact_patches"])
def artifact_delete(spark, sf):
    t = Tables(spark, sf)
    return art.delete(t["artifacts"], t["artifact_tags"], t["artifact_patches"])[2]


@register("artifact_delete_remaining_tags", "A7", f"""
SELECT * FROM artifact_tags WHERE artifact_id NOT IN (SELECT artifact_id FROM {_OWNED_PATCH})""",
          fixtures=["artifacts", "artifact_tags", "artifact_patches"])
def artifact_delete_remaining_tags(spark, sf):
    t = Tables(spark, sf)
    return art.delete(t["artifacts"], t["artifact_tags"], t["artifact_patches"])[1]


@register("artifact_touch", "A8", f"""
SELECT a.artifact_id, a.name, a.type, a.format, a.size_bytes, a.storage_path, a.created_at,
  CASE WHEN l.last IS NULL THEN a.expires_at ELSE greatest(a.expires_at, l.last + INTERVAL '10' DAY) END AS expires_at,
  a.metadata, a.swarm_token
FROM artifacts a LEFT JOIN (SELECT artifact_id, swarm_token, max(accessed_at) AS last FROM artifact_access
                            GROUP BY artifact_id, swarm_token) l
  ON a.artifact_id = l.artifact_id AND a.swarm_token = l.swarm_token""", fixtures=["artifacts", "artifact_access"])
def artifact_touch(spark, sf):
    t = Tables(spark, sf)
    return art.touch(t["artifacts"], t["artifact_access"])


@register("artifact_purge", "A9", f"SELECT * FROM artifacts WHERE expires_at < {NOW}", fixtures=["artifacts"])
def artifact_purge(spark, sf):
    t = Tables(spark, sf)
    return art.purge(t["artifacts"], t["artifact_tags"], ARTIFACT_CLOCK)[2]


@register("artifact_purge_live_tags", "A9", f"""
SELECT * FROM artifact_tags WHERE artifact_id NOT IN (SELECT artifact_id FROM artifacts WHERE expires_at < {NOW})""",
          fixtures=["artifacts", "artifact_tags"])
def artifact_purge_live_tags(spark, sf):
    t = Tables(spark, sf)
    return art.purge(t["artifacts"], t["artifact_tags"], ARTIFACT_CLOCK)[1]


@register("artifact_content_type", "A10", """
SELECT artifact_id, format, CASE format WHEN 'json' THEN 'application/json' WHEN 'csv' THEN 'text/csv'
  WHEN 'text' THEN 'text/plain' ELSE 'application/octet-stream' END AS content_type FROM artifacts""",
          fixtures=["artifacts"])
def artifact_content_type(spark, sf):
    return art.content_type(Tables(spark, sf)["artifacts"])


@register("artifact_extend", "A11", f"""
SELECT a.artifact_id, a.name, a.type, a.format, a.size_bytes, a.storage_path, a.created_at,
  CASE WHEN p.d IS NULL THEN a.expires_at ELSE greatest(a.expires_at, {NOW} + p.d * INTERVAL '1' DAY) END AS expires_at,
  a.metadata, a.swarm_token
FROM artifacts a LEFT JOIN (SELECT artifact_id, max(expiry_days) AS d FROM {_OWNED_PATCH} WHERE expiry_days > 0
                            GROUP BY artifact_id) p ON a.artifact_id = p.artifact_id""",
          fixtures=["artifacts", "artifact_patches"])
def artifact_extend(spark, sf):
    t = Tables(spark, sf)
    return art.extend(t["artifacts"], t["artifact_patches"], ARTIFACT_CLOCK)


@register("artifact_state", "A5", f"""
SELECT * FROM ({_UPDATED}) AS u WHERE artifact_id NOT IN (SELECT artifact_id FROM {_OWNED_PATCH})""",
          fixtures=["artifacts", "artifact_patches"])
def artifact_state(spark, sf):
    """The artifact table kept as a StateLog: the initial rows, the rows the
    owners' patches changed, and tombstones for the owners' deletes."""
    from cairn.sources.statelog import StateLog
    from cairn.session import work_dir
    t = Tables(spark, sf)
    a = t["artifacts"]
    state = StateLog(spark, work_dir(spark, "artifact-state"), ["artifact_id"],
                     ", ".join(f"{n} {ty}" for n, ty in a.dtypes))
    state.upsert(a)
    updated = art.update(a, t["artifact_patches"], ARTIFACT_CLOCK)
    state.upsert(updated.join(a, list(a.columns), "left_anti"))
    _, _, deleted = art.delete(updated, t["artifact_tags"], t["artifact_patches"])
    state.delete(deleted.select("artifact_id"))
    return state.current()
