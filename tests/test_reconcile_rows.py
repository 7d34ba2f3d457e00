"""Differing rows against EXCEPT ALL both ways."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.operators import sync

SCHEMA = "k int, j string, v double, w int"


def rows(rng, n):
    return [(rng.choice([None, *range(12)]), rng.choice(["a", None]), rng.choice([None, 0.5, float("nan"), 1.0]), rng.choice([None, 1, 2])) for _ in range(n)]


@pytest.mark.parametrize("bits,levels", [(1, 1), (3, 3), (12, 2)])
def test_matches_except_all(spark, bits, levels):
    rng = random.Random(bits)
    a = rows(rng, 150)
    b = [x for x in a if rng.random() > 0.1] + rows(rng, 10) + a[:7]
    s, t = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    got = Counter()
    for r in sync.reconcile_rows(s, t.select("w", "k", "j", "v"), ["k", "j"], bits, levels).collect():
        got[r.side, repr((r.k, r.j, r.v, r.w))] += r.copies
        keys = [{(x[0], x[1]) for x in side} for side in (a, b)]
        assert r.kind == ("changed" if all((r.k, r.j) in k for k in keys) else "missing")
    source = Counter((("source", repr(tuple(x)))) for x in s.exceptAll(t).collect())
    replica = Counter((("replica", repr(tuple(x)))) for x in t.exceptAll(s).collect())
    assert got == source + replica


def test_equal_and_empty_sides(spark):
    s = spark.createDataFrame(rows(random.Random(1), 50), SCHEMA)
    assert sync.reconcile_rows(s, s.orderBy("v"), ["k"]).count() == 0
    assert sync.reconcile_rows(s.limit(0), s, ["k"]).agg(F.sum("copies")).first()[0] == 50
    assert {r.kind for r in sync.reconcile_rows(s, s.limit(0), ["k"]).collect()} == {"missing"}
    with pytest.raises(ValueError):
        sync.reconcile_rows(s, s.drop("w"), ["k"])
