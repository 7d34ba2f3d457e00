"""Operator 11, divergence of sources: how far the word use of one source lies from each other one.

Within a language every kept term (in at least ``least_docs`` of its documents) has a rounded
probability in every source, ``p = 1 + floor(SCALE * (count + 1) / (N + V))``; the divergence of
source g from h is the sum over all kept terms of ``f = floor((p - q)^2 / q)``, with p of g and q of h.
Most counts are nought, so for a pair

    sum f = (V - |g| - |h|) f(p0, q0)  +  sum over terms of g of f(p, q0)
          + sum over terms of h of f(p0, q)  +  corrections of the terms of both,

with p0, q0 the values at count 0 and the correction of a term
``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``.  The two middle sums come from how often each source has
each count.  The corrections come from a frequent-pattern tree: a term's row is its nonzero counts in the order of
the sources; equal rows are one row with a multiplicity; rows that begin alike share a path, and a
node's multiplicity is the sum of the rows through it.  For each node and each of its ancestors the correction of the two is taken
once, times the node's multiplicity, in both directions.

All arithmetic is of integers: p and q are below 2^31, f below 2^62; sums are decimals, and
inside the tree integers modulo 2^64, which is exact as a value is a 64-bit integer by contract.

Scale.  Documents are read once; a task counts terms into a table that it sends on when it has ``HELD``
entries, so a hot source or term arrives added up.  One shuffle by (language, term) builds the
rows, one by row counts equal rows.  Rows are then *range* partitioned in their own order, so that each task
holds neighbouring paths of the tree: a subtree that spans two tasks is in both, with a part of the
multiplicity each, and the parts add up.  A task builds its tree from ``ROWS`` sorted rows at a time, as arrays.
A row is as long as the number of sources that have the term, and the result has a row for each pair
of sources.  Ranks up to ``top`` are cut within each partition before they meet.

Edge cases.  Null text, language and source count as empty strings, and the empty string is a language and a source
like any other.  A source without kept terms has pairs (0 if the language has none at all) and no terms.  A
language of one source has no pairs.  Ties go by the bytes of the item.  Repeated rows count as often as they are there.  An
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import ship, table, written

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: Entries that a task counts before it sends them on, rows of an Arrow batch, rows of one tree.
HELD, SENT, ROWS = 300_000, 50_000, 20_000

#: A-Z to a-z; letters and all bytes beyond ASCII stay; the rest parts terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(content: bytes) -> list[bytes]:
    """The terms of a text: runs of letters A-Z (in lower case) and non-ASCII characters."""
    return content.translate(_FOLD).split()


def _count(batches):
    """(lang, source, term, n, docs) partial sums; a source's mere presence is a row with an empty term."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def send():
        for key, counts in n.items():
            words, of = [b"", *counts], docs[key]
            for i in range(0, len(words), SENT):
                part = words[i:i + SENT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(part), pa.string()), pa.array([key[1]] * len(part), pa.string()),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in part], pa.int64()),
                     pa.array([of[w] for w in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    for batch in batches:
        for lang, source, content in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "content"))):
            key = (lang, source)
            have = n.setdefault(key, Counter())
            held -= len(have)
            own = terms(content)
            have.update(own)
            held += len(have)
            docs.setdefault(key, Counter()).update(set(own))
            if held > HELD:
                yield from send()
                held = 0
    yield from send()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) partial sums, to be added up; each source that occurs has a row of an empty term."""
    ship(docs.sparkSession)
    blank = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), blank).alias("lang"), F.coalesce(F.col(source_col).cast("string"), blank).alias("source"),
                       F.coalesce(F.col(text_col), blank).cast("binary").alias("content"))
    return rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")


def term_rows(partials: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, counts): the kept terms with their nonzero counts as array<struct<source, n>> in the
    order of the sources; rows of empty terms tell which sources occur."""
    per = (partials.repartition("lang", "term").groupBy("lang", "term", "source")
           .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return (per.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"),
                                            F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
            .where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"))


def p_of(n: Column, total: Column, terms_: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + 1) / (total + terms)), exact for any counts."""
    whole = "decimal(38,0)"
    return F.call_function("div", F.lit(scale).cast("decimal(11,0)") * (n + 1).cast("decimal(20,0)"), (total + terms_).cast(whole)) + F.lit(1)


def f_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Stats:
    """What every part needs of a table of documents, counted once and written to the shared folder.

    ``rows``: kept terms (``term_rows``); ``groups``: (lang, source, total, kept, terms, zero): tokens and kept terms
    of a source, kept terms of its language, p at count 0; ``langs``: (lang, lang_total, terms)."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, scale: int = SCALE):
        self.scale = scale
        rows = written(term_rows(count_terms(docs), least_docs), "divergence_rows")
        self.rows = rows.where("term != ''")
        cells = rows.select("lang", "term", F.explode("counts").alias("c")).select("lang", "term", "c.source", "c.n")
        self.cells = cells.where("term != ''")
        real = F.col("term") != ""
        # The empty term's row of a language holds every source that occurs.
        groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(real).alias("kept"))
        langs = rows.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count_if(real).alias("terms"))
        # A language without kept terms has total 0 and terms 0; its p is never used, so the divisor may be 1.
        safe = F.greatest("terms", F.lit(1))
        self.langs = written(langs, "divergence_langs")
        self.groups = written(groups.join(self.langs.select("lang", "terms"), "lang")
                              .withColumn("zero", p_of(F.lit(0), F.col("total"), safe, scale)), "divergence_groups")


def top_terms(stats: Stats, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms a source uses more than its language does."""
    cells = (stats.rows.select("lang", "term", F.col("total").alias("term_total"), F.explode("counts").alias("c"))
             .join(stats.langs, "lang").select("lang", "term", "term_total", "lang_total", "terms", "c.source", "c.n"))
    own = stats.groups.select("lang", "source", F.col("total").alias("own_total"))
    scored = (cells.join(own, ["lang", "source"])
              .withColumn("p", p_of(F.col("n"), F.col("own_total"), F.col("terms"), stats.scale))
              .withColumn("q", p_of(F.col("term_total"), F.col("lang_total"), F.col("terms"), stats.scale))
              .where("n > 0 AND p > q"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return (scored.select("lang", "source", F.col("term").alias("item"), f_of(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def tree_rows(stats: Stats) -> DataFrame:
    """(lang, path, rows): distinct rows with their multiplicity; a path's items are
    struct<source, n, p, zero>, which a row's order sorts as its counts do."""
    own = stats.groups.select("lang", "source", "total", "terms", "zero")
    items = (stats.cells.join(own, ["lang", "source"])
             .withColumn("p", p_of(F.col("n"), F.col("total"), F.col("terms"), stats.scale)))
    paths = (items.groupBy("lang", "term")
             .agg(F.sort_array(F.collect_list(F.struct("source", "n", "p", "zero"))).alias("path"))
             .where(F.size("path") > 1))
    return paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("rows"))


class Tree:
    """A frequent-pattern tree of sorted rows, as arrays: per node its parent, item and multiplicity."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, mult: np.ndarray):
        """``ids``: items of all rows one after another; ``starts``: rows + 1 offsets; ``mult``: multiplicity per row."""
        size = np.diff(starts)
        n, width = len(size), int(size.max(initial=0))
        shared = self.shared(ids, starts, width)
        # A row makes a node for each item after what it shares with the row before it.
        new = np.arange(len(ids)) - np.repeat(starts[:-1], size) >= np.repeat(shared, size)
        number = np.cumsum(new) - 1
        self.item = ids[new]
        self.parent = np.full(len(self.item), -1, np.int64)
        self.mult = np.zeros(len(self.item), np.int64)
        # A row's node at depth d is the latest one made there, so a running maximum of the numbers finds it.
        above = np.full(n, -1, np.int64)
        for d in range(width):
            has = size > d
            here = np.full(n, -1, np.int64)
            at = starts[:-1][has] + d
            here[has] = np.where(new[at], number[at], -1)
            node = np.maximum.accumulate(here)
            fresh = here >= 0
            self.parent[here[fresh]] = above[fresh]
            np.add.at(self.mult, node[has], mult[has])
            above = node

    @staticmethod
    def shared(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """How many first items each row has in common with the row before it."""
        n = len(starts) - 1
        size = np.diff(starts)
        out = np.zeros(n, np.int64)
        same = np.ones(n, bool)
        same[:1] = False
        for d in range(width):
            rows = np.flatnonzero(same)
            rows = rows[(size[rows] > d) & (size[rows - 1] > d)]
            rows = rows[ids[starts[rows] + d] == ids[starts[rows - 1] + d]]
            same = np.zeros(n, bool)
            same[rows] = True
            out[rows] += 1
            if not len(rows):
                break
        return out

    def pairs(self):
        """(nodes, ancestors) for each distance: every combination of a node and an ancestor once."""
        nodes = np.flatnonzero(self.parent >= 0)
        up = self.parent[nodes]
        while len(nodes):
            yield nodes, up
            up = self.parent[up]
            nodes, up = nodes[up >= 0], up[up >= 0]


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrections(batches, rows_per_tree: int = ROWS):
    """Sum of corrections per (lang, source, other), from rows in order; in 64 bits that wrap."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows_per_tree):
            part = batch.slice(first, rows_per_tree)
            langs = part.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            paths, mult = part.column("path"), part.column("rows").to_numpy(zero_copy_only=False)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(codes == code)
                own = paths.take(pa.array(mine))
                flat = own.flatten()
                starts = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                yield from _tree_sums(lang, flat, starts, mult[mine])


def _tree_sums(lang: str, flat: pa.StructArray, starts: np.ndarray, mult: np.ndarray):
    sources = flat.field("source").dictionary_encode()
    names = sources.dictionary
    code = sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts, p, zero = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("n", "p", "zero"))
    # An item is a source with a count.
    levels, level = np.unique(counts, return_inverse=True)
    _, which, ids = np.unique(code * max(1, len(levels)) + level, return_index=True, return_inverse=True)
    tree = Tree(ids, starts, mult)
    code, p, zero = code[which], p[which], zero[which]
    k = len(names)
    places: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    for nodes, ancestors in tree.pairs():
        a, b, m = tree.item[ancestors], tree.item[nodes], tree.mult[nodes]
        pa_, pb, za, zb = p[a], p[b], zero[a], zero[b]
        for x, y, px, py, zx, zy in ((a, b, pa_, pb, za, zb), (b, a, pb, pa_, zb, za)):
            value = f(px, py) - f(px, zy) - f(zx, py) + f(zx, zy)
            place, at = np.unique(code[x] * k + code[y], return_inverse=True)
            total = np.zeros(len(place), np.int64)
            np.add.at(total, at, value * m)
            places.append(place)
            sums.append(total)
    if places:
        place, at = np.unique(np.concatenate(places), return_inverse=True)
        total = np.zeros(len(place), np.int64)
        np.add.at(total, at, np.concatenate(sums))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(place), pa.string()), names.take(pa.array(place // k)), names.take(pa.array(place % k)),
             pa.array(total, pa.int64())], names=["lang", "source", "item", "part_sum"])


def pair_corrections(stats: Stats, rows_per_tree: int = ROWS) -> DataFrame:
    """(lang, source, item, correction): sums over the terms that both sources have."""
    rows = written(tree_rows(stats), "divergence_paths")
    ordered = rows.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    sums = ordered.mapInArrow(partial(_corrections, rows_per_tree=rows_per_tree), "lang string, source string, item string, part_sum bigint")
    return sums.groupBy("lang", "source", "item").agg(F.sum(F.col("part_sum").cast("decimal(38,0)")).alias("correction"))


def single_sums(stats: Stats) -> DataFrame:
    """(lang, source, other_zero, over, under): sums over the terms of a source of f(p, zero of another) and f(zero, p)."""
    own = stats.groups.select("lang", "source", "total", "terms")
    counts = (stats.cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
              .join(own, ["lang", "source"]).withColumn("p", p_of(F.col("n"), F.col("total"), F.col("terms"), stats.scale))
              .select("lang", "source", "p", "m"))
    zeros = stats.groups.select("lang", F.col("zero").alias("other_zero")).distinct()
    wide = "decimal(20,0)"
    p, z, m = F.col("p"), F.col("other_zero"), F.col("m").cast(wide)
    return (counts.join(zeros, "lang").groupBy("lang", "source", "other_zero")
            .agg(F.sum(f_of(p, z).cast(wide) * m).alias("over"), F.sum(f_of(z, p).cast(wide) * m).alias("under")))


def pair_values(stats: Stats) -> DataFrame:
    """(lang, source, item, value, rank): divergence of each source from each other one of its language."""
    names = ["source", "kept", "zero"]
    g = stats.groups.select("lang", "terms", *names)
    h = stats.groups.select("lang", F.col("source").alias("item"), F.col("kept").alias("h_kept"), F.col("zero").alias("h_zero"))
    single = written(single_sums(stats), "divergence_single")
    over = single.select("lang", "source", F.col("other_zero").alias("h_zero"), "over")
    under = single.select("lang", F.col("source").alias("item"), F.col("other_zero").alias("zero"), "under")
    whole = "decimal(38,0)"
    nought = F.lit(0).cast(whole)
    pairs = (g.join(h, "lang").where("source != item")
             .join(over, ["lang", "source", "h_zero"], "left").join(under, ["lang", "item", "zero"], "left")
             .join(pair_corrections(stats), ["lang", "source", "item"], "left"))
    rest = (F.col("terms") - F.col("kept") - F.col("h_kept")).cast("decimal(19,0)")
    exact = (F.coalesce("over", nought) + F.coalesce("under", nought) + F.coalesce("correction", nought)
             + rest * f_of(F.col("zero"), F.col("h_zero")).cast("decimal(19,0)"))
    # The tree's sums wrap at 64 bits; so does the whole, once.
    turn, half = F.lit(Decimal(1 << 64)), F.lit(Decimal(1 << 63))
    rest64 = F.pmod(exact.cast(whole), turn)
    value = F.when(rest64 >= half, rest64 - turn).otherwise(rest64)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return (pairs.select("lang", "source", "item", F.when(F.col("terms") == 0, F.lit(0).cast("bigint")).otherwise(value.cast("bigint")).alias("value"))
            .withColumn("rank", F.row_number().over(order)))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources of a language (``pair``), and per source its ``top`` terms (``term``)."""
    stats = Stats(docs, least_docs, scale)
    return (pair_values(stats).withColumn("part", F.lit("pair"))
            .unionByName(top_terms(stats, top).withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language, and the terms that set a source apart."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, doc, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n,
             1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(gt.total, 0) + v.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v) AS q
      FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN gt USING (lang, source)
      LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
             FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
             LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
words AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM words)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM allpairs
UNION ALL SELECT lang, source, 'term', item, value, rank::INT FROM ranked WHERE rank <= 200
"""
