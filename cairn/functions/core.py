"""Column helpers shared by the operators.  All return built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296


def as_cols(cols: str | Column | Sequence[str | Column]) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the row with the largest ``order`` tuple.

    Expressed as ``max_by(struct(all columns), struct(order))`` so the shuffle
    carries partial aggregates: a key holding a third of all rows is reduced
    map-side to one candidate per partition before it moves.  No window gathers a
    key's rows; with variable-width columns Spark runs it as a sort-based
    aggregate, which spills instead of holding a group in memory.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    order_struct = F.struct(*as_cols(order))
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys)
              .agg(F.max_by(packed, order_struct).alias("_latest"))
              .select(*keys, *[F.col("_latest")[c].alias(c) for c in others]))


def hash_unit(cols: Sequence[str | Column]) -> Column:
    """A repeatable number in [0, 2^32) from the key columns: the first eight hex
    digits of md5 over the keys joined by '|'.  Independent of partitioning and
    of the engine, so a sample drawn with it can be checked by an oracle."""
    text = F.concat_ws("|", *[c.cast("string") for c in as_cols(cols)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def base64_valid(col: Column) -> Column:
    """Strict base64: only the standard alphabet, at most two '=' and only at
    the end, and a length divisible by 4."""
    # Valid text is ASCII, so its byte length (O(1)) is its length.  \z is the very
    # end: $ would let a line break follow.
    return col.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & ((F.octet_length(col) % 4) == 0)


def base64_size(col: Column) -> Column:
    """Decoded size of valid base64 text, from its length and padding."""
    pad = F.when(col.endswith("=="), 2).when(col.endswith("="), 1).otherwise(0)
    return ((F.octet_length(col) / 4).cast("bigint") * 3 - pad).cast("bigint")


def strict_unbase64(col: Column) -> Column:
    """Decode base64 strictly: any character outside the alphabet, misplaced
    padding or a length not divisible by 4 gives null instead of a lenient
    partial decode."""
    return F.when(base64_valid(col), F.try_to_binary(col, F.lit("base64")))


def hours(n: int | Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0))


def days(n: int | Column) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(n.cast("int"), F.lit(0), F.lit(0), F.lit(0))


def ts_lit(value: str) -> Column:
    """A ``timestamp_ntz`` literal, the type the given tables use."""
    return F.lit(value).cast("timestamp_ntz")
