"""Stored profiles that are really reused (P10): mergeable states per batch of a replica.

``ProfileStore.refresh`` profiles the batches of a replica that have no state yet, each alone and in one scan, and writes
a state of bounded size per column: counts, mean and squared deviations, extremes, an HLL sketch of
distinct values and a KLL sketch of the distribution.  ``report`` merges the states of the current batches.  Counts, null counts and
extremes are exact, mean and deviation up to rounding; distinct counts have a relative error of about
``1.04 / 2**(LG_K / 2)`` and quantiles a rank error of about ``2.3 / k**0.9`` (``SKETCH_K``).

Batches never change, so a state is never out of date; a full copy or a compaction is a new batch.  States are entered in
a commit log, so of two writers that profile one batch the first counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import profile as P
from cairn.operators.sync import Replica, Snapshot
from cairn.sources.commitlog import CommitLog

#: Size of the HLL sketches (2**LG_K registers): 0.8 %.
LG_K = 14

STATE_SCHEMA = ("column_name string, rows bigint, n bigint, mean double, m2 double, lo string, hi string, lo_number double, "
                "hi_number double, hll binary, kll binary")


def state_of(df: DataFrame, k: int = P.SKETCH_K) -> DataFrame:
    """One row per column (``STATE_SCHEMA``) and one of column null with the row count, from one scan.

    Numbers and times (as epoch microseconds) have moments and a KLL sketch; extremes of other columns are text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers, times = P.numeric_columns(df), P.datetime_columns(df)
    flat, aggs, rows = [], [F.count(F.lit(1)).alias("rows")], []

    def nothing(kind: str) -> Column:
        return F.lit(None).cast(kind)

    rows.append((nothing("string"), F.col("rows"), F.col("rows"), *map(nothing, ("double", "double", "string", "string", "double", "double", "binary", "binary"))))
    for i, f in enumerate(df.schema.fields):
        c = P._col(f.name)
        number = f.name in numbers or f.name in times
        text = c.cast("string") if not f.dataType.simpleString().startswith(("array", "map", "struct", "variant")) else F.to_json(c)
        flat.append((F.when(P._missing(f), None).otherwise(text)).alias(f"t{i}"))
        aggs += [F.count(f"t{i}").alias(f"n{i}"), F.hll_sketch_agg(f"t{i}", F.lit(LG_K)).alias(f"hll{i}")]
        if number:
            flat.append((P._micros(f.name) if f.name in times else P._clean(f.name, types[f.name])).alias(f"v{i}"))
            aggs += [F.avg(f"v{i}").alias(f"m{i}"), F.var_pop(f"v{i}").alias(f"s{i}"), F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"),
                     F.kll_sketch_agg_double(f"v{i}", F.lit(k)).alias(f"kll{i}")]
            some = F.col(f"n{i}") > 0
            rows.append((F.lit(f.name), F.col("rows"), F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"s{i}") * F.col(f"n{i}"), nothing("string"), nothing("string"),
                         F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"hll{i}"), F.when(some, F.col(f"kll{i}"))))
        else:
            aggs += [F.min(f"t{i}").alias(f"lo{i}"), F.max(f"t{i}").alias(f"hi{i}")]
            rows.append((F.lit(f.name), F.col("rows"), F.col(f"n{i}"), nothing("double"), nothing("double"), F.col(f"lo{i}"), F.col(f"hi{i}"),
                         nothing("double"), nothing("double"), F.col(f"hll{i}"), nothing("binary")))
    names = [x.split()[0] for x in STATE_SCHEMA.split(", ")]
    return P._rows_of(df.select(*flat).agg(*aggs), rows, names)


def merge_states(states: DataFrame, k: int = P.SKETCH_K) -> DataFrame:
    """The profile of all batches whose states these are: one row per column."""
    counted = states.where("column_name IS NULL").agg(F.sum("rows").alias("n")).first()["n"]
    total = F.lit(counted or 0).cast("bigint")
    # Moments of two parts: the deviations add up, and so does what their means lie apart.
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).otherwise(F.struct(
            n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2")))

    part = F.struct("n", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2"))
    per = states.where("column_name IS NOT NULL").groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count("mean").alias("with_moments"), F.aggregate(F.sort_array(F.collect_list(part)), zero, add).alias("moments"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lo_number").alias("min"), F.max("hi_number").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("approx_unique"),
        F.kll_merge_agg_double("kll", F.lit(k)).alias("kll"), F.count("kll").alias("sketches"))
    quartiles = F.when(F.col("sketches") > 0, F.kll_sketch_get_quantile_double("kll", F.array(*map(F.lit, P.QUARTILES))))
    numeric = F.col("with_moments") > 0
    return per.select(
        "column_name", "count", (total - F.col("count")).alias("null_count"),
        F.when(numeric, F.col("moments.mean")).alias("mean"),
        F.when(numeric & (F.col("count") > 1), F.sqrt(F.col("moments.m2") / (F.col("count") - 1))).alias("std"),
        "min", "max", F.col("lo").alias("min_text"), F.col("hi").alias("max_text"), "approx_unique",
        *[quartiles[i].alias(f"p{int(q * 100)}") for i, q in enumerate(P.QUARTILES)])


class ProfileStore:
    """Profile states of one replica, below ``<root>/_profile``."""

    def __init__(self, replica: Replica, k: int = P.SKETCH_K):
        self.replica, self.k = replica, k
        self.path = f"{replica.root}/_profile"
        self.commits = CommitLog(replica.spark, f"{self.path}/_log")

    def states(self) -> dict[str, dict]:
        """The entry that counts for each profiled batch folder."""
        out: dict[str, dict] = {}
        for e in self.commits.entries():
            out.setdefault(e["batch"], e)
        return out

    def refresh(self, snapshot: Snapshot | None = None) -> list[str]:
        """Profile the batches that have no state; returns their job ids."""
        done, new = self.states(), []
        for e in (snapshot or self.replica.snapshot()).batches():
            if e["folder"] not in done:
                rows = self.replica.read(Snapshot([{**e, "strategy": "full"}]))
                state = f"state-{uuid.uuid4().hex}"
                state_of(rows, self.k).coalesce(1).write.parquet(f"{self.path}/{state}")
                self.commits.append({"batch": e["folder"], "job_id": e["job_id"], "state": state, "rows": e["rows_processed"]})
                new.append(e["job_id"])
        return new

    def report(self) -> DataFrame:
        """The profile of the current replica; batches without a state are profiled first."""
        snapshot = self.replica.snapshot()
        self.refresh(snapshot)
        states = self.states()
        paths = [f"{self.path}/{states[e['folder']]['state']}" for e in snapshot.batches()]
        spark = self.replica.spark
        return merge_states(spark.read.schema(STATE_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], STATE_SCHEMA), self.k)
