"""Operator 4, line deduplication: levelled sorted runs of line hashes.

The store keeps what is known about line keys in *runs*: tables sorted by key
hash with the columns ``key, n_docs, keeper``.  Batches of lines arrive in
order; the first batch that brings a key fixes its keeper.

* ``add`` reduces a batch to one row per key, anti-joins the runs' *decided* keys
  (those already found in ``min_docs`` documents: their keeper and their fate
  are known, so nothing more needs storing) and writes the rest as a new run of
  level 0.  A line that appears everywhere is thus stored a few times, not
  once per batch.
* ``compact`` merges the runs of a level into one run of the next level when
  there are ``fanout`` of them, so the number of runs stays logarithmic in the
  number of batches and each row is rewritten once per level.
* ``view`` sums the runs: the keys' document counts (exact below ``min_docs``,
  at least ``min_docs`` beyond) and keepers.

``dedup_lines`` feeds documents in descending ranges of their id, so the keeper is
the largest id that holds the line.  Everything is DataFrame operations:
narrow rows (16-byte hash and id) are counted by (key, id) and then by key, both
with partial aggregation, so a line that a third of the documents share is
reduced before each shuffle.  Texts are shuffled once, by id.

The rule: a text is split at ``\\n``; a line's key is the line without the ASCII
white space at both ends and with A-Z in lower case.  Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all
their lines but those in the largest id holding the key (every repeat within
that document stays).

Edge cases.  Null and empty text is one empty line.  A null id is less than
any other and is one document.  Rows with the same id count as one document.
A document that loses every line keeps the empty text.  An empty table gives an
empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import lower_ascii, strip_ascii, table, text_or_empty
from cairn.session import work_dir

RUN_SCHEMA = "key binary, n_docs bigint, keeper bigint, age bigint"
#: Id of rows whose id is null: less than any other.
NULL_ID = -(2 ** 63)


def line_key(line: Column) -> Column:
    return lower_ascii(strip_ascii(line))


def key_hash(line: Column, min_chars: int) -> Column:
    """16-byte hash of an eligible line's key, else null."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key.cast("binary"))))


class LineRuns:
    """Levelled sorted runs below ``path``; see the module's text."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int, fanout: int = 3):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.levels: list[list[str]] = []
        self.count = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        self.count += 1
        path = f"{self.path}/level={level}/run={self.count:06d}"
        rows.sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        """One row per key of these runs.  The run with the least age came first
        and holds the keeper."""
        rows = self.spark.read.schema(RUN_SCHEMA).parquet(*paths)
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min_by("keeper", "age").alias("keeper"),
                                       F.min("age").alias("age"))

    def view(self) -> DataFrame:
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self._merged(paths)

    def add(self, lines: DataFrame) -> None:
        """``lines``: key, id; one batch, later in order than all before."""
        keys = (lines.groupBy("key", "id").agg(F.lit(1).alias("one"))
                     .groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper")))
        if self.count:
            decided = self.view().where(F.col("n_docs") >= self.min_docs).select("key")
            keys = keys.join(decided, "key", "left_anti")
        self._write(keys.withColumn("age", F.lit(self.count).cast("bigint")), 0)
        self.compact()

    def compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                paths, self.levels[level] = self.levels[level], []
                self._write(self._merged(paths), level + 1)


def batch_bounds(keyed: DataFrame, batches: int) -> list[int]:
    """Upper bounds of id ranges of about equal numbers of documents."""
    cuts = keyed.stat.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    return sorted({int(c) for c in cuts})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Per row of ``docs``: ``id, n_lines, n_dropped, kept`` (the text that stays)."""
    spark = docs.sparkSession
    root = work_dir(spark, "line_dedup")
    ident = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID))
    base = docs.select(ident.alias("id"), text_or_empty(text_col).alias("content"))
    lines = F.split("content", "\n", -1)
    placed = F.transform(lines, lambda x, i: F.struct(key_hash(x, min_chars).alias("key"), i.cast("int").alias("pos")))
    # Rows of one id are one document, but each has its own places: rows are told apart by a digest.
    digest = F.unhex(F.md5(F.col("content").cast("binary")))
    keyed = base.select("id", digest.alias("digest"), F.filter(placed, lambda x: x["key"].isNotNull()).alias("lines"))
    keyed.where(F.size("lines") > 0).write.parquet(f"{root}/keys")
    placed = spark.read.schema("id bigint, digest binary, lines array<struct<key: binary, pos: int>>").parquet(f"{root}/keys")
    keyed = placed.select("id", F.col("lines.key").alias("keys"))

    runs = LineRuns(spark, f"{root}/runs", min_docs, fanout)
    bounds = batch_bounds(keyed, batches)
    for low, high in reversed(list(zip([None, *bounds], [*bounds, None]))):
        part = keyed
        if low is not None:
            part = part.where(F.col("id") > low)
        if high is not None:
            part = part.where(F.col("id") <= high)
        runs.add(part.select("id", F.explode("keys").alias("key")))

    common = runs.view().where(F.col("n_docs") >= min_docs).select("key", "keeper")
    dropped = (placed.select("id", "digest", F.inline("lines")).join(common, "key").where("id != keeper")
                     .groupBy("id", "digest").agg(F.collect_set("pos").alias("dropped")))
    # The places that stay, by a set difference; each line is then fetched by its place, so the time is linear in the lines.
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    kept = F.transform(F.array(lines), lambda ls: F.transform(stays, lambda i: F.get(ls, i)))[0]
    return (base.withColumn("digest", digest).join(dropped, ["id", "digest"], "left")
                .select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("id"), F.size(lines).cast("bigint").alias("n_lines"),
                        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
                        F.when(F.col("dropped").isNull(), F.col("content")).otherwise(F.concat_ws("\n", kept)).alias("kept")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
