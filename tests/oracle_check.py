"""Run registered queries in Spark and their oracle texts in DuckDB and
compare row count, column names and an order-insensitive hash of the values.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cairn.plans.fixtures import GIVEN_TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def _digest(rows):
    keyed = sorted(repr(tuple(_norm(x) for x in r)) for r in rows)
    h = hashlib.sha256()
    for k in keyed:
        h.update(k.encode())
    return h.hexdigest(), keyed


def duck(sf_dir: str):
    con = duckdb.connect()
    for n in GIVEN_TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    con.execute("SET TimeZone = 'UTC'")
    return con


PLAN_FLAGS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
              "MapInPandas", "FlatMapGroupsInPandas")


def plan_flags(df):
    """Operators of the executed plan that do not scale or leave the JVM."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [f for f in PLAN_FLAGS if f in plan]


def compare(spark, sf_dir, keys=None, verbose=True, flags=None):
    import __spark_entry__ as E
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
            if flags is not None:
                flags[k] = plan_flags(df)
        except Exception as exc:  # report and go on
            results[k] = ("spark-error", str(exc)[:400])
            if verbose:
                print(f"{k:34s} SPARK ERROR {str(exc)[:400]}")
            continue
        el = time.time() - t0
        if k not in ors:
            results[k] = ("rows-only", len(srows))
            if verbose:
                print(f"{k:34s} rows-only {len(srows)} rows {el:.1f}s")
            continue
        try:
            rel = con.execute(ors[k])
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as exc:
            results[k] = ("oracle-error", str(exc)[:400])
            if verbose:
                print(f"{k:34s} ORACLE ERROR {str(exc)[:400]}")
            continue
        si = sorted(range(len(cols)), key=lambda i: cols[i])
        di = sorted(range(len(dcols)), key=lambda i: dcols[i])
        s_sorted = [tuple(r[i] for i in si) for r in srows]
        d_sorted = [tuple(r[i] for i in di) for r in drows]
        sh, sk = _digest(s_sorted)
        dh, dk = _digest(d_sorted)
        ok_cols = sorted(cols) == sorted(dcols)
        ok = ok_cols and len(srows) == len(drows) and sh == dh
        results[k] = ("ok" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{k:34s} {'ok' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} {el:.1f}s")
            if not ok:
                if not ok_cols:
                    print("   cols", sorted(cols), sorted(dcols))
                a, b = set(sk), set(dk)
                for x in sorted(a - b)[:3]:
                    print("   spark only:", x[:300])
                for x in sorted(b - a)[:3]:
                    print("   duck only: ", x[:300])
    return results


if __name__ == "__main__":
    from cairn.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = build_session("local[8]", 8)
    res = compare(spark, sf, keys)
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    print(f"\n{len(res) - len(bad)} of {len(res)} fine; problems: {sorted(bad)}")
