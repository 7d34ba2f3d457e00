"""Sampling and profiling.

The profile follows pandas ``describe`` semantics (sample standard deviation,
linear-interpolated quartiles, nulls skipped, NaN counted as missing) but is
computed with aggregations that stay distributed at any size:

* count, mean, std, min and max for every column in one aggregation pass;
* exact quartiles by rank selection (``column_quantiles``): three scans, each
  one wide aggregate over all columns (no row is exploded), close in on the values at the wanted
  ranks.  No values are shuffled and no task ever holds all values of a
  column, unlike a global ``percentile`` whose final merge runs in one task.
  Built-in expressions only; no Python runs on the data;
* states of a batch's profile that merge (``ProfileStore``), so that a replica's new batch is profiled alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.core import hash_unit, TWO_POW_32

QUARTILES = (0.25, 0.5, 0.75)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _DATETIME)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# -- sampling ------------------------------------------------------------------

def sample_first(df: DataFrame, n: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """First n rows; with an order this is a top-k (per-partition heaps)."""
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)


def sample_random(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Row-level Bernoulli sample (D8), seeded."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be within 0..1")
    if fraction == 1.0:
        return df
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_hash(df: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """Repeatable sample: rows whose key hash falls below fraction * 2^32.
    The same rows come out at any partitioning and in any engine."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be within 0..1")
    return df.where(hash_unit(keys) < F.lit(fraction * TWO_POW_32))


# -- exact quantiles -------------------------------------------------------------

#: Size of the KLL sketches that bracket the ranks.
SKETCH_K = 4096


def _rank_error(k: int) -> float:
    """Twice the rank error (about 99 % confidence) of a KLL sketch of size k; a bracket that misses is narrowed again."""
    return min(1.0, 4.6 / k ** 0.9)


class _Search:
    """The hunt for the value of one rank of a column: the rank lies among the
    ``size`` values above ``x`` and below ``y`` (None: no bound); ``base`` values are
    not above ``x``."""

    def __init__(self, rank: int, n: int):
        self.rank, self.x, self.y, self.base, self.size = rank, None, None, 0, n
        self.value = None

    def bracket(self, error: float) -> tuple[float, float]:
        p = (self.rank - self.base) / max(self.size - 1, 1)
        return max(0.0, p - error), min(1.0, p + error)

    def narrow(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        """Go on in the part of (x, y) that holds the rank, cut at the values a <= b."""
        at = self.base
        for value, count, x, y in ((None, below, self.x, a), (a, at_a, None, None), (None, between, a, b), (b, at_b, None, None)):
            if self.rank < at + count:
                if value is not None:
                    self.value = value
                else:
                    self.x, self.y, self.base, self.size = x, y, at, count
                return
            at += count
        self.size -= at - self.base
        self.x, self.base = b, at


def column_quantiles(df: DataFrame, values: Sequence[F.Column], probs: Sequence[float] = QUARTILES,
                     k: int = SKETCH_K, small: int = 20000) -> list[tuple[int, float, float]]:
    """Exact quantiles with linear interpolation: (position in ``values``, prob, value).

    ``values`` are double columns (nulls skipped, no NaN); one without values has no quantiles.  Each scan is one aggregate
    over all columns with states of bounded size: (1) a KLL sketch per column gives a bracket of two values around
    each wanted rank; (2) counts below, at and between the two tell which part holds the rank; a part of more than
    ``small`` values is sketched and cut again (it shrinks some hundred times each time); (3) the values of
    the parts, at most ``small`` each, are read off.  A rank that falls on a bracket value, such as
    one that a third of the rows have, ends there."""
    probs, error = list(probs), _rank_error(k)
    # The values as plain columns, so that what is counted below stays a short expression.
    df = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    values = [F.col(f"v{i}") for i in range(len(values))]
    ends = F.array(*[F.lit(max(0.0, min(1.0, q + d))) for q in probs for d in (-error, error)])
    aggs = [x for i, v in enumerate(values) for x in (F.count(v).alias(f"n{i}"), F.kll_sketch_agg_double(v, F.lit(k)).alias(f"s{i}"))]
    first = df.agg(*aggs).select(*[c for i in range(len(values)) for c in (
        f"n{i}", F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", ends)).alias(f"at{i}"))]).first()
    search: dict[tuple[int, int], _Search] = {}
    marks: dict[tuple[int, int], tuple[float, float]] = {}
    for i in range(len(values)):
        n = first[f"n{i}"]
        for j, q in enumerate(probs):
            # The rank and, where it lies between two, the next one.
            for rank in {math.floor((n - 1) * q), math.ceil((n - 1) * q)} if n else ():
                search[i, rank] = _Search(rank, n)
                marks[i, rank] = tuple(first[f"at{i}"][2 * j:2 * j + 2])

    def inside(i: int, x: float | None, y: float | None) -> F.Column:
        ok = values[i].isNotNull()
        ok = ok if x is None else ok & (values[i] > F.lit(x))
        return ok if y is None else ok & (values[i] < F.lit(y))

    def part(key: tuple[int, int]) -> tuple:
        return key[0], search[key].x, search[key].y

    todo = [key for key, s in search.items() if s.size > small]
    while todo:
        cuts = sorted({(*part(key), *marks[key]) for key in todo}, key=repr)
        # Per cut the part that a value falls in: 0 below a, 1 at a, 2 between, 3 at b.
        parts_of = [F.when(inside(i, x, y), F.when(values[i] < a, 0).when(values[i] == a, 1).when(values[i] < b, 2).when(values[i] == b, 3))
                    .alias(f"c{c}") for c, (i, x, y, a, b) in enumerate(cuts)]
        row = df.select(*parts_of).agg(*[F.count_if(F.col(f"c{c}") == w).alias(f"{name}{c}") for c in range(len(cuts))
                                         for w, name in enumerate(("below", "a", "mid", "b"))]).first()
        for key in todo:
            c = cuts.index((*part(key), *marks[key]))
            search[key].narrow(*marks[key], *[row[f"{x}{c}"] for x in ("below", "a", "mid", "b")])
        todo = [key for key in todo if search[key].value is None and search[key].size > small]
        if todo:
            parts = sorted({part(key) for key in todo}, key=repr)
            sketched = df.agg(*[F.kll_sketch_agg_double(F.when(inside(*p), values[p[0]]), F.lit(k)).alias(f"s{c}") for c, p in enumerate(parts)])
            row = sketched.select(*[F.kll_sketch_get_quantile_double(f"s{parts.index(part(key))}", F.array(*map(F.lit, search[key].bracket(error))))
                                    .alias(f"m{c}") for c, key in enumerate(todo)]).first()
            marks.update({key: tuple(row[f"m{c}"]) for c, key in enumerate(todo)})
    open_ = [key for key, s in search.items() if s.value is None]
    if open_:
        parts = sorted({part(key) for key in open_}, key=repr)
        row = df.agg(*[F.array_sort(F.collect_list(F.when(inside(*p), values[p[0]]))).alias(f"v{c}") for c, p in enumerate(parts)]).first()
        for key in open_:
            s = search[key]
            s.value = row[f"v{parts.index(part(key))}"][s.rank - s.base]
    out = []
    for i in range(len(values)):
        for q in probs if first[f"n{i}"] else ():
            at = (first[f"n{i}"] - 1) * q
            low, high = search[i, math.floor(at)].value, search[i, math.ceil(at)].value
            out.append((i, q, low if low == high else low + (high - low) * (at - math.floor(at))))
    return out


def exact_quantiles(long_df: DataFrame, probs: Sequence[float] = QUARTILES,
                    accuracy: int = SKETCH_K, small: int = 2000) -> DataFrame:
    """``column_quantiles`` per group of rows: ``long_df`` has columns ``g`` (an int group id; few groups) and ``v``
    (double, no nulls or NaN).  Returns ``g, q, value``."""
    groups = sorted(r["g"] for r in long_df.select("g").distinct().collect())
    found = column_quantiles(long_df, [F.when(F.col("g") == g, F.col("v")) for g in groups], probs, max(8, accuracy), small) if groups else []
    return long_df.sparkSession.createDataFrame([(groups[i], q, float(v)) for i, q, v in found], "g int, q double, value double")


def _col(name: str) -> F.Column:
    """A column by its name as it is, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _rows_of(wide: DataFrame, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """One wide aggregate row as several rows: ``rows`` of columns or values."""
    def value(x):
        return x if isinstance(x, F.Column) else F.lit(x)
    return wide.select(F.inline(F.array(*[F.struct(*[value(x).alias(n) for x, n in zip(r, names)]) for r in rows])))


def _clean(col_name: str, dtype) -> F.Column:
    c = _col(col_name).cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = F.when(F.isnan(_col(col_name)), F.lit(None).cast("double")).otherwise(c)
    return c


def _moments(df: DataFrame, cols: Sequence[str], conv, with_std: bool = True) -> DataFrame:
    aggs = []
    for i in range(len(cols)):
        x = F.col(f"v{i}")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = df.select(*[conv(c).alias(f"v{i}") for i, c in enumerate(cols)]).agg(*aggs)
    return _rows_of(wide, [(c, *[F.col(f"{a}{i}") for a in ("n", "m", "s", "lo", "hi")]) for i, c in enumerate(cols)],
                    ("column_name", "count", "mean", "std", "min", "max"))


def _approx_quartiles(df: DataFrame, cols: Sequence[str], conv, accuracy: int) -> DataFrame:
    """Quartiles from ``percentile_approx`` sketches: one pass, a sketch of
    fixed size per column (rank error about 1/accuracy of the rows)."""
    wide = df.agg(*[F.percentile_approx(conv(c), list(QUARTILES), accuracy).alias(f"q{i}")
                    for i, c in enumerate(cols)])
    return _rows_of(wide, [(c, *[F.col(f"q{i}")[k] for k in range(3)]) for i, c in enumerate(cols)],
                    ("column_name", "p25", "p50", "p75"))


def _names(spark, cols: Sequence[str]) -> DataFrame:
    """(g, column_name) for the profiled columns (metadata, one row each)."""
    return spark.createDataFrame(list(enumerate(cols)), "g int, column_name string")


def _profile(df: DataFrame, cols: Sequence[str], conv, approx: bool = False,
             accuracy: int = 10000) -> DataFrame:
    """Moments and quartiles per column.  The moments are one aggregation
    pass with fixed-size buffers (partial per task); the quartiles come from
    rank selection (exact) or from sketches (``approx``)."""
    mom = _moments(df, cols, conv)
    if approx:
        return mom.join(_approx_quartiles(df, cols, conv, accuracy), "column_name", "left")
    found = {(i, q): v for i, q, v in column_quantiles(df, [conv(c) for c in cols])}
    rows = [(c, *[found.get((i, q)) for q in QUARTILES]) for i, c in enumerate(cols)]
    return mom.join(df.sparkSession.createDataFrame(rows, "column_name string, p25 double, p50 double, p75 double"), "column_name", "left")


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                    accuracy: int = 10000) -> DataFrame:
    """Per numeric column: count, mean, std, min, 25%, 50%, 75%, max.

    Quartiles are exact by default (pandas ``describe`` semantics).
    ``approx=True`` takes them from ``percentile_approx`` sketches instead, in one scan."""
    cols = list(columns or numeric_columns(df))
    types = {f.name: f.dataType for f in df.schema.fields}
    out = _profile(df, cols, lambda c: _clean(c, types[c]), approx, accuracy)
    return out.select("column_name", F.col("count").cast("bigint").alias("count"), "mean", "std",
                      "min", "p25", "p50", "p75", "max")


def _micros(c: str) -> F.Column:
    return F.unix_micros(_col(c).cast("timestamp")).cast("double")


def _from_micros(col: F.Column) -> F.Column:
    return F.timestamp_micros(F.round(col).cast("bigint")).cast("timestamp_ntz")


def profile_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P5: per timestamp column: count, mean, min, quartiles, max (no std).
    Computed on epoch microseconds and cast back (session time zone UTC)."""
    cols = list(columns or datetime_columns(df))
    out = _profile(df, cols, _micros)
    return out.select("column_name", F.col("count").cast("bigint").alias("count"),
                      *[_from_micros(F.col(c)).alias(c) for c in ("mean", "min", "p25", "p50", "p75", "max")])


def profile_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, unique, top (most frequent; ties by smallest value), freq.
    Value counts are partial-aggregated per partition, so a value holding a
    third of all rows is counted before it moves.  A column with only nulls
    is listed with count and unique 0."""
    cols = list(columns or text_columns(df))
    pairs = F.array(*[F.struct(F.lit(i).alias("g"), _col(c).cast("string").alias("v"))
                      for i, c in enumerate(cols)])
    vc = (df.select(F.inline(pairs)).where(F.col("v").isNotNull())
          .groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")))
    stats = vc.groupBy("g").agg(
        F.sum("c").cast("bigint").alias("count"),
        F.count("v").cast("bigint").alias("unique"),
        F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("top"),
        F.max("c").cast("bigint").alias("freq"))
    return (_names(df.sparkSession, cols).join(stats, "g", "left")
            .select("column_name", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
                    F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"), "top", "freq"))


def profile_text_sketch(df: DataFrame, columns: Sequence[str] | None = None, items: int = 10000, candidates: int = 100) -> DataFrame:
    """P6 without a shuffle of all values: count, approx_unique (HLL, 0.8 % standard error), top and freq.

    One scan keeps a sketch of distinct values and one of at most ``items`` frequent ones per column; a second counts the
    ``candidates`` most frequent exactly.  ``top`` and ``freq`` are exact: a value that is no candidate is no more frequent than the last
    candidate's upper bound or the sketch's error (3.5 / ``items`` of the rows).  A column whose best candidate isn't above both
    has no value that stands out, and goes through ``profile_text``."""
    cols = list(columns or text_columns(df))
    texts = df.select(*[_col(c).cast("string").alias(f"t{i}") for i, c in enumerate(cols)])
    first = texts.agg(F.count(F.lit(1)).alias("rows"), *[x for i in range(len(cols)) for x in (
        F.count(f"t{i}").alias(f"n{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(f"t{i}", F.lit(14))).alias(f"u{i}"),
        F.call_function("approx_top_k", F.col(f"t{i}"), F.lit(candidates), F.lit(items)).alias(f"top{i}"))]).first()
    found = {i: [r for r in first[f"top{i}"] or () if r["item"] is not None] for i in range(len(cols))}
    named = F.array(*[F.struct(F.lit(i).alias("g"), F.when(F.col(f"t{i}").isin([r["item"] for r in rows]), F.col(f"t{i}")).alias("v"))
                      for i, rows in found.items() if rows] or [F.struct(F.lit(-1).alias("g"), F.lit(None).cast("string").alias("v"))])
    counted: dict[int, list[tuple[int, bytes, str]]] = {}
    for r in texts.select(F.inline(named)).where(F.col("v").isNotNull()).groupBy("g", "v").count().collect():
        counted.setdefault(r["g"], []).append((-r["count"], r["v"].encode(), r["v"]))
    sure, unsure = [], []
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        best = min(counted.get(i, []), default=None)
        # Null is an item of the sketch too.
        listed = first[f"top{i}"] or ()
        others = max(3.5 / items * first["rows"], min(r["count"] for r in listed) if len(listed) >= candidates else 0)
        if not n:
            sure.append((c, 0, 0, None, None))
        elif best and -best[0] > others:
            sure.append((c, n, first[f"u{i}"], best[2], -best[0]))
        else:
            unsure.append((c, first[f"u{i}"]))
    schema = "column_name string, count bigint, approx_unique bigint, top string, freq bigint"
    out = df.sparkSession.createDataFrame(sure, schema)
    if unsure:
        near = df.sparkSession.createDataFrame(unsure, "column_name string, approx_unique bigint")
        out = out.unionByName(profile_text(df, [c for c, _ in unsure]).drop("unique").join(near, "column_name"))
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column (NaN counts as missing)."""
    fields = df.schema.fields
    wide = df.agg(*[F.count_if(_missing(f)).alias(f"z{i}") for i, f in enumerate(fields)])
    return _rows_of(wide, [(f.name, F.col(f"z{i}")) for i, f in enumerate(fields)], ("column_name", "null_count"))


def _missing(f) -> F.Column:
    miss = _col(f.name).isNull()
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        miss = miss | F.isnan(_col(f.name))
    return miss


def profile_table(df: DataFrame, table_name: str, fraction: float = 1.0, seed: int = 42,
                  info: DataFrame | None = None) -> DataFrame:
    """The whole report in long form: (table_name, column_name, statistic,
    value).  Numeric statistics as numbers, datetime statistics as whole epoch
    microseconds, null counts for every column and the sample size.

    One aggregation gives the moments, null counts and row count of all
    columns, and one shared search the exact quantiles of the numeric and
    datetime columns together.
    ``info`` is the table's catalog row (C5 output: column_count, row_count,
    size_bytes); its numbers come out as statistics of column '*'."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be within (0, 1]")
    sample = sample_random(df, fraction, seed)
    fields = sample.schema.fields
    types = {f.name: f.dataType for f in fields}
    num, dt = numeric_columns(sample), datetime_columns(sample)
    stat_cols = num + dt

    def conv(c):
        return _micros(c) if c in dt else _clean(c, types[c])

    aggs, triples = [F.count(F.lit(1)).alias("rows")], [("*", "sample_rows", F.col("rows").cast("double"))]
    flat = []
    for i, f in enumerate(fields):
        flat.append(_missing(f).alias(f"missing{i}"))
        aggs.append(F.count_if(F.col(f"missing{i}")).alias(f"z{i}"))
        triples.append((f.name, "null_count", F.col(f"z{i}").cast("double")))
    for i, c in enumerate(stat_cols):
        flat.append(conv(c).alias(f"v{i}"))
        x = F.col(f"v{i}")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}")]
        stats = [("count", f"n{i}"), ("mean", f"m{i}"), ("min", f"lo{i}"), ("max", f"hi{i}")]
        if c in num:
            aggs.append(F.stddev_samp(x).alias(f"s{i}"))
            stats.append(("std", f"s{i}"))
        for stat, alias in stats:
            val = F.col(alias).cast("double")
            triples.append((c, stat, F.round(val, 0) if c in dt and stat != "count" else val))
    wide = sample.select(*flat).agg(*aggs)
    out = _rows_of(wide, triples, ("column_name", "statistic", "value"))
    if stat_cols:
        rows = [(stat_cols[i], f"p{int(q * 100)}", float(math.floor(v + 0.5)) if i >= len(num) else v)
                for i, q, v in column_quantiles(sample, [conv(c) for c in stat_cols])]
        out = out.unionByName(sample.sparkSession.createDataFrame(rows, "column_name string, statistic string, value double"))
    else:
        t = profile_text(sample)
        out = out.unionByName(t.selectExpr(
            "column_name", "stack(3, 'count', CAST(count AS DOUBLE), 'unique', CAST(unique AS DOUBLE),"
            " 'freq', CAST(freq AS DOUBLE)) AS (statistic, value)"))
    if info is not None:
        out = out.unionByName(info.selectExpr(
            "'*' AS column_name", "stack(3, 'catalog_column_count', CAST(column_count AS DOUBLE),"
            " 'catalog_row_count', CAST(row_count AS DOUBLE), 'catalog_size_bytes',"
            " CAST(size_bytes AS DOUBLE)) AS (statistic, value)"))
    return out.select(F.lit(table_name).alias("table_name"), "column_name", "statistic", "value")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max] of the finite values; the maximum
    belongs to the last bin.  Empty bins are listed with count 0.  Infinite
    values lie outside of all bins (``outside`` counts them, on every row); null and NaN are missing."""
    spark = df.sparkSession
    x = _col(col).cast("double")
    inf = F.lit(float("inf"))
    there = x.isNotNull() & ~F.isnan(x)
    finite = there & (F.abs(x) != inf)
    mm = df.agg(F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi"),
                F.count_if(there & (F.abs(x) == inf)).alias("outside")).first()
    outside = F.lit(mm["outside"]).cast("bigint").alias("outside")
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if mm["lo"] is None:
        return edges.select("bin", F.lit(None).cast("double").alias("lower"),
                            F.lit(None).cast("double").alias("upper"), F.lit(0).cast("bigint").alias("count"), outside)
    lo, hi = float(mm["lo"]), float(mm["hi"])
    width = (hi - lo) / bins
    if hi > lo:
        b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)).cast("int") + 1, F.lit(bins))
    else:
        b = F.lit(1)
    counts = df.where(finite).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return (edges.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), outside))


def profile_cache(profiles: DataFrame, meta: DataFrame, force_refresh: bool = False) -> DataFrame:
    """P10: per table, reuse the latest stored profile unless the table changed
    after it (or there is none) or a refresh is forced."""
    latest = profiles.groupBy("table_id").agg(F.max("profiled_at").alias("profiled_at"))
    out = meta.select("table_id", "last_updated").join(latest, "table_id", "left")
    stale = (F.col("profiled_at").isNull() | F.col("last_updated").isNull()
             | (F.col("profiled_at") < F.col("last_updated")))
    action = F.lit("refresh") if force_refresh else F.when(stale, "refresh").otherwise("reuse")
    return out.select("table_id", "last_updated", "profiled_at", action.alias("action"))
