"""Operator 6, n-gram Jaccard self-join with prefix trees.

A document's set is its distinct word 5-grams (as 64-bit hashes; fewer than five words: the whole
sequence).  Documents link if 100 * |x n y| >= 75 * |x u y|, that is |x n y| >= 3/7 (|x| + |y|).

1. *Sets.*  One pass gives each document its size and set key (64-bit hash of the set).  Equal sets
   are one set from here on, so a thousand copies cost as much as one.
2. *Shared n-grams.*  A second pass deals n-grams into buckets of their hash, as compressed
   arrays.  A bucket finds the n-grams that at least two sets hold, and their number of sets; all others
   (most) can't count in any intersection.  N-grams found in many documents of a
   small sample are dealt over all buckets with a salt; that they are shared is known already.
3. *Survivors.*  The shared n-grams are dealt by set.  A set needs ceil(3/4 n) shared n-grams to have
   a partner at all; the others leave.  Survivors keep them in one global order: rarest first, then by hash.
4. *Candidates.*  Two partners must have a common n-gram among the first n - ceil(3/4 n) + 1 of each (the
   prefix; n-grams that aren't shared come first and take up places).  Each prefix n-gram links its sets to
   the least of them; the connected components of that are the *candidate groups*: partners are never in different groups.
5. *Trie join.*  A group's sets are stored in a path-compressed trie along the
   global order.  A set walks the trie and carries the overlap so far, shared by all sets below a node.  A
   subtree is left when overlap + the fewer of both sides' remaining n-grams can't reach 3/7 (|x| + least
   size below), or when all sets below are already connected with the walker (links within a component
   add nothing to it).
   Below the root a set enters only the subtrees that hold a set with one of its prefix n-grams.
6. *Large groups* (more than ``CHUNK`` sets) are cut into chunks by hash.  First each chunk is joined
   by itself, and a few hub sets walk all chunks, which connects what is much alike.
   Then the sets outside of the group's largest component walk those other chunks that hold a set with one of
   their prefix n-grams, so their visits grow with the candidates and not with the group.
7. The components of all links, mapped back to documents, are the result.

All 64-bit hashes are taken as exact.  Sharing uses their top 48 bits: a false match
would need two different n-grams of one pair of sets to agree in 48 bits, and would change an intersection by one.

Edge cases.  Null and empty texts (and those of white space only) have the empty set and are their own component.
Rows with the same id are one node: their component is shared.  A null id takes part with the least possible
id and is returned as null.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import hashing
from cairn.llm.common import ship, table, text_bytes, written
from cairn.llm.components import components

SHINGLE = 5
#: Entries per bucket that are aimed at, and entries that a task gathers before it deals them out.
BUCKET_ENTRIES = 4_000_000
FLUSH_ENTRIES = 1_000_000
#: Entries of a bucket that are sorted at once.
PIECE_ENTRIES = 250_000
CHUNK = 1000
HUBS = 8
#: The sample that finds n-grams common enough to be salted: its size, and the share that makes one common.
SAMPLE_DOCS, COMMON_SHARE = 4000, 0.01
TOKEN_BITS = 48
NULL_ID = -(2 ** 63)


def need(n: int) -> int:
    """Least overlap with any partner: ceil(3/4 n)."""
    return (3 * n + 3) // 4


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class Shingler:
    def __init__(self):
        self.words = hashing.Words(hashing.word_classes())

    def sets(self, content: pa.Array):
        """For each text of a binary column: its sorted distinct n-gram hashes."""
        empty = np.empty(0, np.uint64)
        for _, n, data, offsets in hashing.runs(content):
            h, first = self.words.tokens(data, offsets)
            m = max(0, len(h) - SHINGLE + 1)
            g = np.zeros(m, np.uint64)
            for k in range(SHINGLE):
                g = (g + h[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
                g ^= g >> np.uint64(32)
            g = hashing.mix(g)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if b - a >= SHINGLE:
                    yield np.unique(g[a:b - SHINGLE + 1])
                elif b > a:
                    yield np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64)
                else:
                    yield empty


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.astype(np.uint64).view(np.int64))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash's top 32 bits, so order by hash is order by bucket."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def document_sets(docs: DataFrame) -> DataFrame:
    """``id, n, set_key`` per row; ``docs``: id, content."""
    def rows(batches):
        shingler = Shingler()
        for batch in batches:
            sizes, keys = [], []
            for s in shingler.sets(batch.column("content")):
                sizes.append(len(s))
                keys.append(set_key(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), signed(np.array(keys, np.uint64))],
                names=["id", "n", "set_key"])

    return docs.mapInArrow(rows, "id bigint, n bigint, set_key bigint")


def common_ngrams(docs: DataFrame, total: int) -> np.ndarray:
    """N-grams found in at least COMMON_SHARE of a sample of about SAMPLE_DOCS rows.

    Only decides which n-grams are dealt with a salt; the result doesn't depend on it."""
    if total < 2 * SAMPLE_DOCS:
        sample = docs
    else:
        sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(total // SAMPLE_DOCS)) == 0)
    least = max(8, int(SAMPLE_DOCS * COMMON_SHARE))

    def rows(batches):
        shingler = Shingler()
        for batch in batches:
            sets = list(shingler.sets(batch.column("content")))
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            # What is common in the whole is common in some batch: batches hold at most 2,000 rows.
            some = counts >= 2
            yield pa.RecordBatch.from_arrays([signed(values[some]), pa.array(counts[some])], names=["g", "c"])

    found = (sample.mapInArrow(rows, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))
                   .where(F.col("c") >= least).orderBy(F.desc("c"), "g").limit(100_000).collect())
    return np.sort(np.array([r.g for r in found], np.int64).view(np.uint64))


def shared_ngrams(docs: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """Per set-key bucket, blobs of (set key, n-gram, number of sets) of the shared n-grams.

    A blob holds each of its set keys once, in order and as differences; sizes don't travel here."""
    spark = docs.sparkSession
    common_ = spark.sparkContext.broadcast(common)
    shift = np.uint64(64 - TOKEN_BITS)

    def deal(batches):
        shingler = Shingler()
        often = common_.value
        tokens, owners, keys, seen, held = [], [], [], {}, 0

        def flush():
            t = np.concatenate(tokens)
            tokens.clear()
            k, place = np.unique(np.array(keys, np.uint64), return_inverse=True)
            o = np.repeat(place.astype(np.int32), np.array(owners))
            at = bucket_of(t, buckets).astype(np.int32)
            if len(often):
                where = np.minimum(np.searchsorted(often, t), len(often) - 1)
                hot = often[where] == t
                at[hot] = (hashing.mix(k[o[hot]]) % np.uint64(buckets)).astype(np.int64)
            else:
                hot = np.zeros(len(t), bool)
            order = np.lexsort((t, hot, at))
            t, o, hot, at = t[order], o[order], hot[order], at[order]
            edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (hot[1:] != hot[:-1]), [True]]))
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                used, local = np.unique(o[a:b], return_inverse=True)
                out.append((int(at[a]), bool(hot[a]), pack_sorted(t[a:b] >> shift), pack(local), pack_sorted(k[used])))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.bool_(), *[pa.binary()] * 3))],
                names=["bucket", "hot", "t", "o", "k"])

        for batch in batches:
            for s in shingler.sets(batch.column("content")):
                key = set_key(s) if len(s) else None
                if key is None or key in seen:
                    continue
                seen[key] = True
                tokens.append(s)
                owners.append(len(s))
                keys.append(key)
                held += len(s)
                if held >= FLUSH_ENTRIES:
                    yield flush()
                    tokens, owners, keys, seen, held = [], [], [], {}, 0
        if held:
            yield flush()

    def find(batches):
        for _, parts in groups(batches, "bucket"):
            plain = [p for p in parts if not p["hot"]]
            hot = [p for p in parts if p["hot"]]
            found = [shared(t, k) for t, k in entries(plain)]
            for t, k in entries(hot):
                order = np.lexsort((t, k))
                t, k = t[order], k[order]
                once = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
                # The true number of sets isn't known here; as all sorted last, hash order does.
                found.append((t[once], k[once], np.full(int(once.sum()), 0xFFFF, np.uint16)))
            t, k, df = (np.concatenate(x) for x in zip(*found))
            del found
            if not len(t):
                continue
            order = np.argsort(k, kind="stable")
            t, k, df = t[order], k[order], df[order]
            at = bucket_of(k, buckets)
            edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            key = (df.astype(np.uint64) << np.uint64(TOKEN_BITS)) | t
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                used, local = np.unique(k[a:b], return_inverse=True)
                out.append((int(at[a]), pack(key[a:b]), pack(local), pack_sorted(used)))
            yield found_batch(out)

    dealt = docs.mapInArrow(deal, "bucket int, hot boolean, t binary, o binary, k binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(find, FOUND)


FOUND = "bucket int, t binary, o binary, k binary"


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))],
                                      names=["bucket", "t", "o", "k"])


def set_sizes(sets: DataFrame, buckets: int) -> DataFrame:
    """Per set-key bucket, blobs of set keys (``k``) and their sizes (``o``); ``t`` is null.  ``sets``: n, set_key."""
    def rows(batches):
        held, count = [], 0

        def flush():
            k = np.concatenate([np.asarray(b.column("set_key")).view(np.uint64) for b in held])
            n = np.concatenate([np.asarray(b.column("n")) for b in held])
            k, first = np.unique(k, return_index=True)
            n, at = n[first], bucket_of(k, buckets)
            edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            return found_batch([(int(at[a]), None, pack(n[a:b]), pack_sorted(k[a:b]))
                                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= FLUSH_ENTRIES:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    return sets.where("n > 0").select("n", "set_key").mapInArrow(rows, FOUND)


def entries(parts: list[dict]):
    """N-grams and set keys of dealt blobs (which are used up), a range of n-grams at a time.

    Whole are only the n-grams and their sets' places; what is sorted has about ``PIECE_ENTRIES`` entries."""
    runs = []
    for p in parts:
        runs.append((unpack_sorted(p["t"]), unpack(p["o"]).astype(np.int32), unpack_sorted(p["k"])))
        p.clear()
    total = sum(len(t) for t, _, _ in runs)
    if not total:
        return
    # A bucket is a range of hashes, so equal steps hold about as many entries each.
    pieces = -(-total // PIECE_ENTRIES)
    least, most = min(int(t[0]) for t, _, _ in runs), max(int(t[-1]) for t, _, _ in runs)
    limits = np.array([least + (most - least) * i // pieces for i in range(1, pieces)], np.uint64)
    cuts = [[0, *np.searchsorted(t, limits).tolist(), len(t)] for t, _, _ in runs]
    for i in range(pieces):
        some = [(t[c[i]:c[i + 1]], k[o[c[i]:c[i + 1]]]) for (t, o, k), c in zip(runs, cuts) if c[i] < c[i + 1]]
        if some:
            t, k = (np.concatenate(x) for x in zip(*some))
            yield t, k


def shared(t: np.ndarray, k: np.ndarray):
    """The entries whose n-gram is in two or more sets, once per set, with that number (0xFFFF at most)."""
    order = np.argsort(t, kind="stable")  # merges the blobs' sorted runs
    t = t[order]
    same = t[1:] == t[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    t, order = t[twice], order[twice]
    k = k[order]
    order = np.lexsort((k, t))
    t, k = t[order], k[order]
    once = np.ones(len(t), bool)
    once[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    t, k = t[once], k[once]
    _, inverse, counts = np.unique(t, return_inverse=True, return_counts=True)
    df = np.minimum(counts, 0xFFFF).astype(np.uint16)[inverse] if len(t) else np.empty(0, np.uint16)
    many = df > 1
    return t[many], k[many], df[many]


def groups(batches, *cols: str):
    """(key, rows) of consecutive rows with equal ``cols``."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in cols)
            if rows and k != key:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def survivors(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``set_key, n, ngrams``: sets with enough shared n-grams, in the global order."""
    def rows(batches):
        for _, parts in groups(batches, "bucket"):
            known = [p for p in parts if p["t"] is None]
            parts = [p for p in parts if p["t"] is not None]
            if not parts:
                continue
            t = np.concatenate([unpack(p["t"]) for p in parts])
            k = np.concatenate([unpack_sorted(p["k"])[unpack(p["o"]).astype(np.int64)] for p in parts])
            order = np.lexsort((t, k))
            t, k = t[order], k[order]
            keys, first = np.unique(np.concatenate([unpack_sorted(p["k"]) for p in known]), return_index=True)
            size = np.concatenate([unpack(p["o"]) for p in known])[first]
            n = size[np.searchsorted(keys, k)].astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            kept = [(int(k[a]), int(n[a]), t[a:b].astype("<u8").tobytes())
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b - a >= need(int(n[a]))]
            if kept:
                keys, sizes, sets = zip(*kept)
                yield pa.RecordBatch.from_arrays([signed(np.array(keys, np.uint64)), pa.array(sizes, pa.int64()),
                                                  pa.array(sets, pa.binary())], names=["set_key", "n", "ngrams"])

    return (found.unionByName(sizes).repartition("bucket").sortWithinPartitions("bucket")
                 .mapInArrow(rows, "set_key bigint, n bigint, ngrams binary"))


def prefix_of(tokens: np.ndarray, n: int) -> np.ndarray:
    """The shared n-grams of a set of ``n`` that are in its prefix: partners have one of them in common."""
    return tokens[:len(tokens) - need(n) + 1]


def prefixes(sets: DataFrame) -> DataFrame:
    """``g, set_key`` for each n-gram of each set's prefix."""
    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for n, raw in zip(batch.column("n").to_pylist(), batch.column("ngrams")):
                parts.append(prefix_of(np.frombuffer(raw.as_py(), "<u8"), n))
            keys = np.repeat(np.asarray(batch.column("set_key")), [len(t) for t in parts])
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(parts)), pa.array(keys)], names=["g", "set_key"])

    return sets.mapInArrow(rows, "g bigint, set_key bigint")


class Node:
    __slots__ = ("seg", "children", "docs", "least", "deepest", "one")

    def __init__(self, seg: np.ndarray):
        self.seg = seg
        self.children: dict[int, Node] = {}
        self.docs: list[int] = []
        self.least = 1 << 62   # least size of a set here or below
        self.deepest = 0       # most n-grams below this node's segment
        self.one: int | None = None  # a set that all sets here and below are connected with


class Trie:
    """Path-compressed trie of sets in global order, with their components."""

    def __init__(self):
        self.root = Node(np.empty(0, np.int64))
        self.sizes: list[int] = []
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []
        self.below: dict[int, set[int]] = {}  # prefix n-gram: the root's children whose sets have it in their prefix

    def add(self, size: int) -> int:
        self.sizes.append(size)
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(j)] = self.find(i)

    def insert(self, doc: int, tokens: np.ndarray) -> None:
        node, rest = self.root, tokens
        size = self.sizes[doc]
        first = int(tokens[0])
        for t in prefix_of(tokens, size).tolist():
            self.below.setdefault(t, set()).add(first)
        while True:
            node.least = min(node.least, size)
            node.deepest = max(node.deepest, len(rest))
            if node.one is not None and self.find(node.one) != self.find(doc):
                node.one = None
            if not len(rest):
                node.docs.append(doc)
                return
            child = node.children.get(int(rest[0]))
            if child is None:
                leaf = Node(rest)
                leaf.docs, leaf.least, leaf.one = [doc], size, doc
                node.children[int(rest[0])] = leaf
                return
            m = min(len(rest), len(child.seg))
            differ = np.flatnonzero(rest[:m] != child.seg[:m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.seg):  # split the segment
                upper = Node(child.seg[:same])
                upper.children[int(child.seg[same])] = child
                upper.least, upper.one = child.least, child.one
                upper.deepest = child.deepest + len(child.seg) - same
                child.seg = child.seg[same:]
                node.children[int(rest[0])] = upper
                child = upper
            node, rest = child, rest[same:]

    def walk(self, doc: int, tokens: np.ndarray) -> None:
        """Link ``doc`` with the sets of the trie, leaving out those it is connected with."""
        if self.root.children:
            self._walk(self.root, doc, tokens, 0, 0)

    def _walk(self, node: Node, doc: int, tokens: np.ndarray, at: int, overlap: int) -> None:
        size = self.sizes[doc]
        stack = [(node, at, overlap, False)]
        while stack:
            node, at, overlap, after = stack.pop()
            if after:  # all below was visited: is it one component now?
                reps = [c.one for c in node.children.values()] + node.docs
                if None not in reps and len({self.find(r) for r in reps}) == 1:
                    node.one = reps[0]
                continue
            if node.one is not None and self.find(node.one) == self.find(doc):
                continue
            seg = node.seg
            left = len(tokens) - at
            least = -(-3 * (size + node.least) // 7)
            if overlap + min(left, len(seg) + node.deepest) < least:
                continue
            if len(seg):
                place = at + np.searchsorted(tokens[at:], seg)
                inside = place < len(tokens)
                overlap += int(np.count_nonzero(tokens[place[inside]] == seg[inside]))
                at = at + int(np.searchsorted(tokens[at:], seg[-1], "right"))
            for other in node.docs:
                if self.find(other) != self.find(doc) and 7 * overlap >= 3 * (size + self.sizes[other]):
                    self.links.append((doc, other))
                    self.join(doc, other)
            if overlap + min(len(tokens) - at, node.deepest) < least and node.children:
                continue
            below = node.children.values()
            if node is self.root:
                firsts = set().union(*(self.below.get(t, ()) for t in prefix_of(tokens, size).tolist()))
                below = [node.children[t] for t in firsts]
            if 2 * len(below) >= len(node.children):
                stack.append((node, 0, 0, True))
            stack.extend((c, at, overlap, False) for c in below)


def trie_links(rows: DataFrame) -> DataFrame:
    """Links ``a, b`` within each (comp, chunk).  ``rows``: comp, chunk, own, label, set_key, n, ngrams;
    own rows are stored, the others only walk; rows of one label count as connected."""
    def join(batches):
        key, trie, keys, labels, order = None, None, [], {}, None

        def links():
            if trie is not None and trie.links:
                a, b = (np.array([keys[x[i]] for x in trie.links], np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["comp"], row["chunk"]) != key:
                    yield from links()
                    key, trie, keys, labels = (row["comp"], row["chunk"]), Trie(), [], {}
                doc = trie.add(row["n"])
                keys.append(row["set_key"])
                if row["label"] is not None:
                    trie.join(labels.setdefault(row["label"], doc), doc)
                tokens = np.frombuffer(row["ngrams"], "<u8")
                trie.walk(doc, tokens)
                if row["own"]:
                    trie.insert(doc, tokens)
        yield from links()

    cols = ["comp", "chunk", "own", "label", "set_key", "n", "ngrams"]
    return (rows.select(*cols).repartition("comp", "chunk")
                .sortWithinPartitions("comp", "chunk", F.desc("own"), "n", "set_key").mapInArrow(join, "a bigint, b bigint"))


def similar_pairs(sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` (set keys) that connect all partners among the survivors."""
    prefix = written(prefixes(sets), "ngram_prefixes")
    hubs = prefix.groupBy("g").agg(F.min("set_key").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = prefix.join(hubs, "g").where("set_key <> hub").select(F.col("set_key").alias("a"), F.col("hub").alias("b")).distinct()
    groups_ = components(near)
    sizes = groups_.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("chunks"))
    placed = written(
        sets.join(groups_, sets.set_key == groups_.node).drop("node").join(sizes, "comp")
            .withColumn("chunk", F.pmod(F.xxhash64("set_key"), F.col("chunks")))
            .withColumn("own", F.lit(True)).withColumn("label", F.lit(None).cast("bigint")), "ngram_groups")
    large = placed.where("chunks > 1")
    if large.isEmpty():
        return written(trie_links(placed), "ngram_links")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    hub_keys = large.groupBy("comp", F.pmod(F.xxhash64("set_key", F.lit(1)), F.lit(HUBS)).alias("j")).agg(
        F.min_by("set_key", F.xxhash64("set_key", F.lit(2))).alias("set_key")).select("comp", "set_key")

    def visiting(rows: DataFrame) -> DataFrame:
        """Rows once for each chunk of their group but their own."""
        return (rows.withColumnRenamed("chunk", "home").withColumn("chunk", every).where("chunk <> home")
                    .withColumn("own", F.lit(False)).select(placed.columns))

    first = written(trie_links(placed.unionByName(visiting(large.join(hub_keys, ["comp", "set_key"], "left_semi").select(placed.columns)))), "ngram_links")
    # What is not connected with its group's largest part yet visits the chunks that may hold a partner.
    parts = components(first)
    known = large.drop("label").join(parts.select("node", F.col("comp").alias("part")), F.col("set_key") == F.col("node"), "left")
    known = known.withColumn("label", F.coalesce("part", "set_key")).drop("node", "part")
    counts = known.groupBy("comp", "label").count()
    largest = counts.groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    known = written(known.join(largest, "comp").select(*placed.columns, "main"), "ngram_known")
    guests = hosted(known.where("label <> main").select(placed.columns), known, prefix)
    second = written(trie_links(known.select(placed.columns).unionByName(guests)), "ngram_links")
    return first.unionByName(second)


def hosted(guests: DataFrame, known: DataFrame, prefix: DataFrame) -> DataFrame:
    """``guests`` once for each other chunk of their group that holds a set with one of their prefix n-grams.

    Only narrow rows meet: an n-gram that a third of a group has is in at most all of its chunks."""
    hosts = prefix.join(known.select("set_key", "comp", "chunk"), "set_key").select("comp", "g", "chunk").distinct()
    wanted = prefix.join(guests.select("set_key", "comp", F.col("chunk").alias("home")), "set_key")
    visits = (wanted.join(hosts, ["comp", "g"]).where("chunk <> home").select("comp", "set_key", "chunk").distinct())
    return (guests.drop("chunk").join(visits, ["comp", "set_key"]).withColumn("own", F.lit(False))
                  .select(guests.columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``id, n_shingles, component_id`` per row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("id"), text_bytes(text_col).alias("content"))
    sets = written(document_sets(base), "ngram_sets")
    total, rows = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # As few buckets as memory allows, since each holds the keys of its sets; but one for each core.
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(total / BUCKET_ENTRIES))
    found = shared_ngrams(base, common_ngrams(base, rows), buckets)
    links = similar_pairs(written(survivors(found, set_sizes(sets, buckets)), "ngram_survivors"), chunk)
    parts = components(links)
    labelled = sets.where("n > 0").select("id", "set_key").join(
        parts.withColumnRenamed("node", "set_key"), "set_key", "left").select("id", F.coalesce("comp", "set_key").alias("label"))
    # An id may stand in several rows; its rows are one node.
    several = sets.where("n > 0").groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi")
    if not several.isEmpty():
        tie = labelled.groupBy("id").agg(F.min("label").alias("b"))
        more = components(labelled.join(tie, "id").select(F.col("label").alias("a"), "b").where("a <> b"))
        labelled = labelled.join(more.withColumnRenamed("node", "label"), "label", "left").select(
            "id", F.coalesce("comp", "label").alias("label"))
    labelled = written(labelled.distinct(), "ngram_labels")
    least = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    by_id = labelled.join(least, "label").select("id", "component_id")
    out = sets.select("id", F.col("n").alias("n_shingles")).join(by_id, "id", "left").withColumn(
        "component_id", F.coalesce("component_id", "id"))
    null = F.lit(NULL_ID)
    return out.select(F.when(F.col("id") != null, F.col("id")).alias("id"), "n_shingles",
                      F.when(F.col("component_id") != null, F.col("component_id")).alias("component_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
