"""Operator 9, benchmark decontamination by winnowing.

Texts are lower-cased (A-Z only) and cut into words.  Both sides are reduced to
winnowed fingerprints: of every ``window`` consecutive hashes of ``k``-grams of
words the least one is kept (the last of equals).  Two texts that share a span
of ``span = window + k - 1`` words share all k-grams of that span, so they keep the
same least hash at the same place of it: no shared span of that length or more is missed.
Each common fingerprint is then *extended* word by word in both directions.
A run of at least ``span`` equal words is a hit, and all its words are marked.
Words are compared as themselves (numbered by the benchmark's vocabulary), so a
hash collision never makes a hit.  Items of fewer than ``span`` words are one
window each; they are found by the hash of their whole word sequence, one pass for each
length that occurs.

Scale.  Documents are read once per block of the benchmark and never shuffled.
The benchmark is cut into blocks of about ``block_bytes`` of text; the index of one block is
what is broadcast, so its size does not grow with the benchmark.  With several
blocks the hits (runs and items, only of rows that have some) are joined by row.
A passage that a third of all documents hold costs one extension per document,
in the task that reads it.

Edge cases.  Null and empty texts have no words and no hits.  Items without
words are no items.  Items are counted by their distinct ids, null ids are one
id (left out of the id list).  Repeated rows are judged one by one.  An empty
benchmark hits nothing; an empty table gives an empty result.  Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import ship, table, text_bytes, written

#: Word bytes: 0-9, A-Z (to lower case), a-z and all bytes of non-ASCII characters; others separate.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)
#: Hash of a k-gram with a word that the benchmark doesn't have: never the least, never looked up.
NONE = np.uint64(2 ** 64 - 1)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram of word numbers; NONE where one of them is 0."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    u = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for i in range(k):
        part = u[i:i + n]
        h = (h + part + np.uint64(1)) * MIX
        h ^= h >> np.uint64(29)
        known &= part != 0
    h = (h * MIX2) >> np.uint64(1)
    h[~known] = NONE
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window (the last of equals)."""
    if len(h) < window:
        return np.empty(0, np.int64)
    best = h[:len(h) - window + 1].copy()
    first = np.arange(len(best))
    at = first.copy()
    for i in range(1, window):
        part = h[i:i + len(best)]
        less = part <= best
        best[less] = part[less]
        at[less] = first[less] + i
    return np.unique(at[best != NONE])


class BenchmarkIndex:
    """The fingerprints of one block of items."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], span: int = 10, k: int = 5):
        self.span, self.k, self.window = span, k, span - k + 1
        self.vocab: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.words: list[list[int]] = []
        found = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            ws = words_of(text)
            if not ws:
                continue
            seq = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
            at = len(self.ids)
            self.ids.append(item_id)
            self.words.append(seq)
            arr = np.array(seq, np.int64)
            if len(seq) < span:
                h = int(gram_hashes(arr, len(seq))[0])
                self.short.setdefault(len(seq), {}).setdefault(h, []).append(at)
                continue
            h = gram_hashes(arr, k)
            for p in winnow(h, self.window).tolist():
                found[int(h[p])].append((at, p))
        self.prints = dict(found)
        self.print_hashes = np.array(sorted(found), np.uint64)
        self.short_hashes = {n: np.array(sorted(d), np.uint64) for n, d in self.short.items()}

    def number(self, words: list[bytes]):
        return map(self.vocab.get, words, repeat(0))

    def runs(self, arr: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, item) of each hit in a sequence of word numbers (0: not
        in the benchmark; also put between texts)."""
        out: list[tuple[int, int, int]] = []
        seq = None
        if len(self.print_hashes):
            h = gram_hashes(arr, self.k)
            at = winnow(h, self.window)
            at = at[member(h[at], self.print_hashes)]
            if len(at):
                seq = arr.tolist()
                done: dict[tuple[int, int], int] = {}
                for p in at.tolist():
                    for item, q in self.prints[int(h[p])]:
                        if done.get((item, p - q), -1) > p:
                            continue
                        a, b = extend(seq, self.words[item], p, q)
                        done[item, p - q] = b
                        if b - a >= self.span:
                            out.append((a, b, item))
        for n, table_ in self.short.items():
            h = gram_hashes(arr, n)
            at = np.nonzero(member(h, self.short_hashes[n]))[0]
            for p in at.tolist():
                seq = arr.tolist() if seq is None else seq
                out += [(p, p + n, item) for item in table_[int(h[p])] if seq[p:p + n] == self.words[item]]
        return out


def member(values: np.ndarray, in_sorted: np.ndarray) -> np.ndarray:
    if not len(in_sorted):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(in_sorted, values), len(in_sorted) - 1)
    return in_sorted[at] == values


def extend(seq: list[int], item: list[int], p: int, q: int) -> tuple[int, int]:
    """The longest run of equal words around seq[p] and item[q]."""
    a, i = p, q
    while a > 0 and i > 0 and seq[a - 1] == item[i - 1]:
        a, i = a - 1, i - 1
    b, j = p, q
    while b < len(seq) and j < len(item) and seq[b] == item[j]:
        b, j = b + 1, j + 1
    return a, b


def scan(texts, index: BenchmarkIndex, most_words: int = 1_000_000):
    """For each text: number of words, hit runs (start, end) and item numbers.
    Texts are taken together, up to ``most_words`` words (or one text), with a
    word that no item has between them."""
    numbers: list[int] = []
    starts: list[int] = []

    def flush():
        arr = np.array(numbers, np.int64)
        per: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        begin = np.array(starts, np.int64)
        for a, b, item in index.runs(arr):
            per[int(np.searchsorted(begin, a, "right")) - 1].append((a, b, item))
        ends = [s - 1 for s in starts[1:]] + [len(numbers) - 1]
        for i, (s, e) in enumerate(zip(starts, ends)):
            hits = per.get(i, ())
            yield e - s, merge([(a - s, b - s) for a, b, _ in hits]), sorted({item for _, _, item in hits})

    for text in texts:
        starts.append(len(numbers))
        numbers.extend(index.number(words_of(text)))
        numbers.append(0)
        if len(numbers) >= most_words:
            yield from flush()
            numbers, starts = [], []
    if starts:
        yield from flush()


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RUNS = "array<struct<start:bigint,stop:bigint>>"
HIT_SCHEMA = f"id bigint, uid bigint, n_words bigint, runs {RUNS}, items array<bigint>, null_item boolean"


def scan_block(docs: DataFrame, items: list[tuple[int | None, bytes | None]], span: int, k: int) -> DataFrame:
    """``docs``: id, uid, content (bytes).  Each row's words, runs and items of one block."""
    index = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(items, span, k))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def rows(batches):
        ix = index.value
        for batch in batches:
            found = list(scan((x.as_py() for x in batch.column("content")), ix))
            ids = [[ix.ids[i] for i in items] for _, _, items in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("uid"), pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"start": a, "stop": b} for a, b in r] for _, r, _ in found], run_type),
                pa.array([sorted({x for x in s if x is not None}) for s in ids], pa.list_(pa.int64())),
                pa.array([None in s for s in ids], pa.bool_())],
                names=["id", "uid", "n_words", "runs", "items", "null_item"])

    return docs.mapInArrow(rows, HIT_SCHEMA)


def merge_runs(df: DataFrame) -> DataFrame:
    """Merge each row's list of run lists (``all_runs``) to ``runs``."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def rows(batches):
        for batch in batches:
            lists = [merge([(r["start"], r["stop"]) for part in x.as_py() for r in part]) for x in batch.column("all_runs")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), pa.array([[{"start": a, "stop": b} for a, b in r] for r in lists], run_type),
                 batch.column("items"), batch.column("null_item")], names=["uid", "runs", "items", "null_item"])

    return df.mapInArrow(rows, f"uid bigint, runs {RUNS}, items array<bigint>, null_item boolean")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5,
                       block_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``docs``: ``id, uid, n_words, runs`` (hit word ranges)
    and ``items`` (ids of the items whose windows occur), ``null_item``."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), text_bytes(item_text_col).alias("content"))
    total = items.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("uid"),
                       text_bytes(text_col).alias("content"))
    if blocks == 1:
        return scan_block(base, [(r[0], bytes(r[1])) for r in items.collect()], span, k)
    base = written(base, "decontaminate_rows")  # fixes uid for the passes
    parts = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "content"), F.lit(blocks)) == b)
        part = scan_block(base, [(r[0], bytes(r[1])) for r in block.collect()], span, k)
        parts.append(written(part if b == 0 else part.where(F.size("runs") > 0), "decontaminate_hits"))
    hits = parts[0].where(F.size("runs") > 0)
    for part in parts[1:]:
        hits = hits.unionByName(part)
    merged = merge_runs(hits.groupBy("uid").agg(
        F.collect_list("runs").alias("all_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.max("null_item").alias("null_item")))
    return (parts[0].select("id", "uid", "n_words").join(merged, "uid", "left")
            .select("id", "uid", "n_words", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"),
                    F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
                    F.coalesce("null_item", F.lit(False)).alias("null_item")))


def n_hit():
    return F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: s + r["stop"] - r["start"])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit().alias("n_hit"),
        (F.size("items") + F.col("null_item").cast("int")).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", span: int = 10, k: int = 5, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` without any hit, columns unchanged.

    A benchmark of one block is one filter.  With several blocks the rows are written once with a
    row number, each block's pass reads texts only and writes the numbers of the rows that it hits, and
    an anti join leaves those out: one block's index is in use at a time."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), text_bytes(item_text_col).alias("content"))
    total = items.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    if blocks == 1:
        return docs.where(~hit_filter(spark, [(r[0], bytes(r[1])) for r in items.collect()], span, k)(text_bytes(text_col)))
    rows = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid")), "clean_rows")
    text = rows.select("uid", F.col("row")[text_col].alias("content")).select("uid", text_bytes("content").alias("content"))
    hits = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "content"), F.lit(blocks)) == b)
        has_hit = hit_filter(spark, [(r[0], bytes(r[1])) for r in block.collect()], span, k)
        hits.append(written(text.where(has_hit("content")).select("uid"), "clean_hits"))
    hit = reduce(DataFrame.unionByName, hits).distinct()
    return rows.join(hit, "uid", "left_anti").select("row.*")


def hit_filter(spark: SparkSession, items: list[tuple[int | None, bytes | None]], span: int, k: int):
    index = spark.sparkContext.broadcast(BenchmarkIndex(items, span, k))

    @F.arrow_udf("boolean")
    def has_hit(content: pa.Array) -> pa.Array:
        return pa.array([bool(r) for _, r, _ in scan((x.as_py() for x in content), index.value)], pa.bool_())

    return has_hit
