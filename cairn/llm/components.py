"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import written


def _pairs(edges: DataFrame) -> DataFrame:
    return (edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _roots(pairs: DataFrame) -> DataFrame:
    """``node, comp``: every node follows its least neighbour, if that is less than
    itself, up to a node that follows none.  Pointer jumping doubles the steps
    taken in each round."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                     .select("node", F.least("node", "near").alias("comp")), "cc_labels")
    while True:
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        moved = written(labels.join(jump, "comp").select(
            "node", F.col("further").alias("comp"), (F.col("further") < F.col("comp")).alias("moved")), "cc_labels")
        labels = moved.select("node", "comp")
        if moved.where("moved").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for all nodes of ``edges`` (a, b: bigint); comp is the least node of the component.

    Each round joins every node to the root of its tree and goes on with the
    graph of the roots, from which inner and repeated edges are gone; it shrinks
    fast, and a component is done when one root is left.  Rounds are written to
    the shared folder.  Neighbours are aggregated partially before they are
    shuffled, so a node with very many of them is no hot spot."""
    pairs = written(_pairs(edges), "cc_pairs")
    rounds: list[DataFrame] = []
    while not rounds or not pairs.isEmpty():
        labels = _roots(pairs)
        rounds.append(labels)
        of_a = labels.select(F.col("node").alias("a"), F.col("comp").alias("to_a"))
        of_b = labels.select(F.col("node").alias("b"), F.col("comp").alias("to_b"))
        pairs = written(_pairs(pairs.join(of_a, "a").join(of_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "cc_pairs")
    out = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        out = out.join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return written(out, "cc_components")
