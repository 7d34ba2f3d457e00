"""Named queries: for every operator of the survey, the Spark DataFrame that
runs it over the given tables, and (where SQL can say it) an independent
DuckDB text that computes the same rows.

Each Spark entry is ``fn(spark, sf_dir) -> DataFrame``.  Oracle texts name the
fixtures they use; ``oracle_sql`` puts those fixtures in front as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans.fixtures import fixture_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY_ID: dict[str, str] = {}


def with_fixtures(names, body: str) -> str:
    body = body.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS (\n{fixture_sql(n, 'duckdb')}\n)" for n in names)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def register(key: str, survey_id: str, oracle: str | None = None, fixtures=()):
    """Decorator: register a Spark query (and its oracle text, if any)."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        SURVEY_ID[key] = survey_id
        if oracle is not None:
            ORACLES[key] = with_fixtures(list(fixtures), oracle)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from cairn.plans import (  # noqa: F401
        reg_sources, reg_sync, reg_catalog, reg_profile, reg_sql, reg_joblog,
        reg_artifacts, reg_streams, reg_governance, reg_joins)
