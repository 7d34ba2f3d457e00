"""State tables derived from the given tables (FIXTURES.md).

Each fixture is one SQL text that both Spark and DuckDB run.  Two placeholders
differ by engine and are replaced literally.  In Spark the fixtures become temp
views over the given parquet tables, so every operator that reads them reads
data Spark derives from the given tables and grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN_TABLES = ("region nation customer supplier part orders lineitem events documents "
                "embeddings pages benchmark labels conversations").split()

# Engine-specific spellings of the two placeholders.
_PLACEHOLDERS = {
    "spark": {
        "{TS}": "TIMESTAMP_NTZ",
        "{B64}": r"regexp_replace(base64(encode(text, 'UTF-8')), '[\r\n]', '')",
    },
    "duckdb": {
        "{TS}": "TIMESTAMP",
        "{B64}": "base64(encode(text))",
    },
}

# Fixed clocks passed to the operators as parameters.
JOB_CLOCK = "2024-01-28 00:00:00"
ARTIFACT_CLOCK = "2024-01-15 00:00:00"

FIXTURES: dict[str, str] = {
    "allowed_tables": """
SELECT concat('t', lpad(concat('', user_id), 6, '0')) AS table_id,
  concat('tab', user_id) AS table_name, concat('s', user_id % 5) AS schema_name,
  'warehouse' AS source, CASE WHEN user_id % 7 = 4 THEN 'inactive' ELSE 'active' END AS status,
  {TS} '2024-01-01 00:00:00' + user_id * INTERVAL '1' HOUR AS created_at
  FROM (SELECT DISTINCT user_id FROM events) AS u""",
    "table_metadata": """
SELECT concat('t', lpad(concat('', user_id), 6, '0')) AS table_id,
  CAST(4 + user_id % 6 AS INTEGER) AS column_count, CAST(1000 * user_id AS BIGINT) AS row_count,
  CAST(65536 * user_id AS BIGINT) AS size_bytes,
  {TS} '2024-01-10 00:00:00' + (user_id % 40) * INTERVAL '1' DAY AS last_updated,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('Monthly figures of user ', user_id) END AS description
  FROM (SELECT DISTINCT user_id FROM events) AS u WHERE user_id % 3 <> 2""",
    "table_tags": """
SELECT concat('t', lpad(concat('', user_id), 6, '0')) AS table_id, 'sales' AS tag
  FROM (SELECT DISTINCT user_id FROM events) AS u WHERE user_id % 2 = 1
UNION ALL
SELECT concat('t', lpad(concat('', user_id), 6, '0')) AS table_id, '2023' AS tag
  FROM (SELECT DISTINCT user_id FROM events) AS u WHERE user_id % 3 = 1
UNION ALL
SELECT concat('t', lpad(concat('', user_id), 6, '0')) AS table_id, 'monthly' AS tag
  FROM (SELECT DISTINCT user_id FROM events) AS u WHERE user_id % 5 = 1""",
    "source_columns": """
SELECT * FROM (VALUES
  ('customer', 1, 'c_custkey', 'NUMBER(38,0)', 'N'), ('customer', 2, 'c_name', 'VARCHAR(18)', 'N'),
  ('customer', 3, 'c_nationkey', 'NUMBER(5)', 'N'), ('customer', 4, 'c_acctbal', 'NUMBER(12,2)', 'Y'),
  ('customer', 5, 'c_mktsegment', 'VARCHAR(9)', 'Y'), ('edge', 1, 'a', 'FLOAT', 'Y'),
  ('edge', 2, 'b', 'BOOLEAN', 'N'), ('edge', 3, 'c', 'DATE', 'Y'), ('edge', 4, 'd', 'TIMESTAMP_NTZ(9)', 'Y'),
  ('edge', 5, 'e', 'TIMESTAMP_TZ(9)', 'Y'), ('edge', 6, 'f', 'TIMESTAMP_LTZ(9)', 'Y'),
  ('edge', 7, 'g', 'DECIMAL(10,2)', 'N'), ('edge', 8, 'h', 'VARIANT', 'Y'), ('edge', 9, 'i', 'ARRAY', 'Y'),
  ('edge', 10, 'j', 'TEXT', 'Y'), ('edge', 14, 'n', 'NUMBER (38,0)', 'Y'), ('edge', 15, 'o', 'VARCHAR (10)', 'Y'), ('edge', 13, 'm', 'VARCHAR(16777216)', 'Y'), ('edge', 11, 'k', 'CHAR(1)', 'Y'), ('edge', 12, 'l', 'BINARY(8388608)', 'Y'))
  AS v(table_name, ordinal, name, declared_type, nullable)""",
    # Declared source columns derived from events: one per event, every
    # declared-type form the parser handles (Y7), growing with the data.
    "declared_columns": """
SELECT concat('tab', user_id) AS table_name, CAST(event_id AS INTEGER) AS ordinal, concat('c', event_id) AS name,
  CASE event_id % 9 WHEN 0 THEN concat('VARCHAR(', 1 + user_id, ')')
    WHEN 1 THEN concat('NUMBER(', 1 + event_id % 38, ',', event_id % 6, ')')
    WHEN 2 THEN concat('NUMBER(', 1 + user_id % 38, ')') WHEN 3 THEN 'FLOAT' WHEN 4 THEN 'TIMESTAMP_NTZ(9)'
    WHEN 5 THEN concat('CHAR(', 1 + user_id % 10, ')') WHEN 6 THEN 'VARIANT'
    WHEN 7 THEN concat('DECIMAL(', 10 + event_id % 20, ',', event_id % 4, ')') ELSE 'BOOLEAN' END AS declared_type,
  CASE WHEN event_type = 'error' THEN 'N' ELSE 'Y' END AS nullable FROM events""",
    # Column policies for G1/G2 (metadata, like source_columns).
    "column_policies": """
SELECT * FROM (VALUES
  ('customer', 'c_acctbal', 'deny'), ('customer', 'c_name', 'redact'), ('customer', 'c_custkey', 'hash'),
  ('orders', 'o_totalprice', 'deny'))
  AS v(table_name, column_name, action)""",
    "registry_actions": """
SELECT event_id AS action_id, concat('s', user_id % 5) AS schema_name,
  concat('tab', user_id) AS table_name, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action,
  ts FROM events""",
    # Tables present in the source warehouse: every user's table except those of
    # users ending in 3, so that some catalog adds must be rejected.
    "source_tables": """
SELECT DISTINCT concat('s', user_id % 5) AS schema_name, concat('tab', user_id) AS table_name
  FROM events WHERE user_id % 10 <> 3""",
    "sync_jobs": """
SELECT concat('j', lpad(concat('', event_id), 8, '0')) AS job_id,
  CASE WHEN user_id % 11 = 10 THEN 't999999' ELSE concat('t', lpad(concat('', user_id), 6, '0')) END AS table_id,
  CASE event_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental' ELSE 'snapshot' END AS strategy,
  CASE WHEN event_id % 20 = 0 THEN 'pending' WHEN event_id % 20 = 1 THEN 'running'
       WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_id % 20 > 1 AND event_type = 'error' THEN concat('Sync failed: code ', user_id) END AS error_message,
  CASE WHEN event_id % 20 <> 0 THEN ts END AS started_at,
  CASE WHEN event_id % 20 > 1 THEN ts + (1 + user_id % 90) * INTERVAL '1' MINUTE END AS completed_at,
  CASE WHEN event_id % 20 > 1 AND event_type <> 'error' THEN user_id * 10 ELSE CAST(0 AS BIGINT) END AS rows_synced,
  CASE WHEN event_id % 20 > 1 AND event_type <> 'error' AND event_id % 3 = 1 AND event_id % 7 <> 0
       THEN event_id * 10 END AS last_value FROM events""",
    "query_jobs": """
SELECT concat('q', lpad(concat('', event_id), 8, '0')) AS job_id,
  concat('SELECT ', user_id) AS query,
  CASE WHEN event_id % 20 = 2 THEN 'pending' WHEN event_id % 20 = 4 THEN 'running'
       WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  ts AS created_at, CASE WHEN event_id % 20 <> 2 THEN ts + INTERVAL '5' SECOND END AS started_at,
  CASE WHEN event_id % 20 NOT IN (2, 4) THEN ts + (1 + user_id % 50) * INTERVAL '1' MINUTE END AS completed_at,
  CASE WHEN event_id % 20 NOT IN (2, 4) AND event_type = 'error' THEN 'Query failed' END AS error,
  CASE WHEN event_id % 20 NOT IN (2, 4) AND event_type <> 'error' THEN concat('results/query_', event_id, '.csv') END AS result_path,
  CASE WHEN event_id % 20 NOT IN (2, 4) AND event_type <> 'error' THEN user_id * 3 END AS row_count
  FROM events""",
    "task_events": """
SELECT concat('k', lpad(concat('', event_id), 8, '0')) AS task_id,
  concat('w', user_id % 6) AS worker,
  CASE user_id % 6 WHEN 0 THEN 'queries' WHEN 1 THEN 'sync' WHEN 2 THEN 'cleanup' WHEN 3 THEN 'adhoc'
       WHEN 4 THEN 'queries' END AS queue,
  CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'reserved' ELSE 'scheduled' END AS state,
  CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'view' THEN 'STARTED' ELSE 'SUCCESS' END AS status,
  concat('task_', event_type) AS name, ts AS time_start,
  CASE WHEN event_type = 'error' THEN concat('code ', user_id, ' at step ', event_id % 9) END AS error FROM events""",
    "worker_pings": """
SELECT * FROM (VALUES ('w0', 2), ('w1', 2), ('w2', 4), ('w4', 2)) AS v(worker, processes)""",
    "artifact_uploads": """
SELECT doc_id AS upload_id,
  CASE WHEN doc_id % 17 = 1 THEN '' ELSE concat('file_', doc_id) END AS name,
  CASE doc_id % 5 WHEN 0 THEN 'data' WHEN 1 THEN 'model' WHEN 2 THEN 'report' WHEN 3 THEN 'other' ELSE 'video' END AS type,
  CASE doc_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'parquet' WHEN 3 THEN 'pickle' WHEN 4 THEN 'text' ELSE 'binary' END AS format,
  CASE WHEN doc_id % 13 = 0 THEN concat('*', {B64}) WHEN doc_id % 19 = 2 THEN concat(substr({B64}, 2), chr(10)) ELSE {B64} END AS content,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 29 AS INTEGER) END AS expiry_days,
  CASE WHEN doc_id % 4 <> 0 THEN concat('{"lang":"', lang, '"}') END AS metadata,
  CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 8 = 1 THEN {EMPTY_TAGS} ELSE {TAGS} END AS tags,
  concat('swarm', doc_id % 4) AS swarm_token FROM documents""",
    "artifacts": """
SELECT concat('a', lpad(concat('', doc_id), 8, '0')) AS artifact_id, concat('file_', doc_id) AS name,
  CASE doc_id % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'model' WHEN 2 THEN 'report' ELSE 'other' END AS type,
  CASE doc_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'parquet' WHEN 3 THEN 'pickle' WHEN 4 THEN 'text' ELSE 'binary' END AS format,
  n_chars AS size_bytes, concat('artifacts/', doc_id) AS storage_path,
  {TS} '2024-01-01 00:00:00' + (doc_id % 720) * INTERVAL '1' HOUR AS created_at,
  {TS} '2024-01-01 00:00:00' + (doc_id % 720 + 24 * (1 + doc_id % 20)) * INTERVAL '1' HOUR AS expires_at,
  concat('{"lang":"', lang, '","src":"', source, '"}') AS metadata,
  concat('swarm', doc_id % 3) AS swarm_token FROM documents""",
    "artifact_tags": """
SELECT concat('a', lpad(concat('', doc_id), 8, '0')) AS artifact_id, 'even' AS tag FROM documents WHERE doc_id % 2 = 0
UNION ALL
SELECT concat('a', lpad(concat('', doc_id), 8, '0')) AS artifact_id, 'third' AS tag FROM documents WHERE doc_id % 3 = 0
UNION ALL
SELECT concat('a', lpad(concat('', doc_id), 8, '0')) AS artifact_id, 'fifth' AS tag FROM documents WHERE doc_id % 5 = 0""",
    "artifact_access": """
SELECT event_id AS access_id, concat('a', lpad(concat('', user_id), 8, '0')) AS artifact_id,
  ts AS accessed_at, CASE WHEN event_id % 5 = 0 THEN 'swarm9' ELSE concat('swarm', user_id % 3) END AS swarm_token
  FROM events""",
    # Patches of non-English documents' artifacts (A5-A7, A11), for some two or
    # three in order.  The owner is wrong for every fourth; name, metadata, expiry
    # and tags are each sometimes absent; tags are sometimes an empty list
    # (clears them); expiry days are sometimes 0 or less (an invalid patch).
    "artifact_patches": """
SELECT concat('a', lpad(concat('', doc_id), 8, '0')) AS artifact_id, patch_seq,
  CASE WHEN (doc_id + patch_seq) % 4 = 1 THEN 'swarm9' ELSE concat('swarm', doc_id % 3) END AS swarm_token,
  CASE WHEN lang = 'de' AND patch_seq < 3 THEN concat('renamed_', doc_id, '_', patch_seq) END AS name,
  CASE WHEN lang = 'fr' THEN concat('{"reviewed":"', source, patch_seq, '"}') END AS metadata,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN (doc_id + patch_seq) % 11 = 0 THEN CAST(patch_seq - 2 AS INTEGER)
       ELSE CAST(1 + (doc_id + patch_seq) % 9 AS INTEGER) END AS expiry_days,
  CASE WHEN lang = 'es' THEN NULL WHEN (doc_id + patch_seq) % 5 = 0 THEN {EMPTY_TAGS}
       ELSE {TAGS} END AS tags
  FROM (SELECT doc_id, lang, source, CAST(1 AS BIGINT) AS patch_seq FROM documents
    UNION ALL SELECT doc_id, lang, source, CAST(2 AS BIGINT) AS patch_seq FROM documents WHERE doc_id % 3 >= 1
    UNION ALL SELECT doc_id, lang, source, CAST(3 AS BIGINT) AS patch_seq FROM documents WHERE doc_id % 3 = 2) AS d
  WHERE lang <> 'en'""",
}

# Engine spellings of the list literals in artifact_uploads and artifact_patches.
_LISTS = {
    "spark": {"{EMPTY_TAGS}": "CAST(array() AS ARRAY<STRING>)",
              "{TAGS}": "array('reviewed', lang)"},
    "duckdb": {"{EMPTY_TAGS}": "CAST([] AS VARCHAR[])",
               "{TAGS}": "['reviewed', lang]"},
}


def fixture_sql(name: str, engine: str) -> str:
    text = FIXTURES[name]
    for k, v in _PLACEHOLDERS[engine].items():
        text = text.replace(k, v)
    for k, v in _LISTS[engine].items():
        text = text.replace(k, v)
    return text.strip()


class Tables:
    """The given tables of one scale folder plus the derived fixtures.

    Given tables are read lazily with ``spark.read.parquet`` so Catalyst prunes
    columns and pushes filters into the scan; fixtures are SQL over temp views.
    """

    # Resolved scans per (session, folder, table): listing the folder and
    # reading the parquet footer is done once, the plan itself stays lazy.
    _SCANS: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def given(self, name: str) -> DataFrame:
        key = (id(self.spark), self.spark.sparkContext.applicationId, self.sf_dir, name)
        df = Tables._SCANS.get(key)
        if df is None:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            Tables._SCANS[key] = df
        return df

    def register(self, names=GIVEN_TABLES) -> "Tables":
        for name in names:
            self.given(name).createOrReplaceTempView(name)
        return self

    def __getitem__(self, name: str) -> DataFrame:
        if name in GIVEN_TABLES:
            return self.given(name)
        text = fixture_sql(name, "spark")
        words = set(re.findall(r"[a-z_]+", text.lower()))
        self.register([n for n in GIVEN_TABLES if n in words])
        return self.spark.sql(text)
