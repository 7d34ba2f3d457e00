"""Column policies (G1, G2): hide or mask columns of a table by a policy
table of (table_name, column_name, action).

Actions: ``deny`` drops the column, ``hash`` replaces it by the SHA-256 hex of
its text, ``redact`` keeps the last four characters and stars the rest.  The
policy rows are table metadata (a few per column), read to the driver to build
one projection; the data is rewritten by built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("deny", "hash", "redact")


def _policy(policies: DataFrame, table: str) -> dict[str, str]:
    rows = policies.where(F.col("table_name") == table).select("column_name", "action").collect()
    out = {r["column_name"]: r["action"] for r in rows}
    bad = sorted(set(out.values()) - set(ACTIONS))
    if bad:
        raise ValueError(f"unknown policy actions {bad}")
    return out


def restrict_columns(df: DataFrame, policies: DataFrame, table: str) -> DataFrame:
    """G1: the table without its denied columns."""
    deny = {c for c, a in _policy(policies, table).items() if a == "deny"}
    return df.select(*[c for c in df.columns if c not in deny])


def _mask(col: Column, action: str) -> Column:
    text = col.cast("string")
    if action == "hash":
        return F.sha2(text, 256)
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(text) - 4, F.lit(0))),
                    F.right(text, F.lit(4)))


def mask_columns(df: DataFrame, policies: DataFrame, table: str) -> DataFrame:
    """Denied columns dropped, hashed and redacted columns rewritten."""
    pol = _policy(policies, table)
    out = []
    for c in df.columns:
        a = pol.get(c)
        if a == "deny":
            continue
        out.append(_mask(F.col(c), a).alias(c) if a in ("hash", "redact") else F.col(c))
    return df.select(*out)
