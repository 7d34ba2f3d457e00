"""Operator 3, token files: Simple-8b coded ids in frames of whole documents.

**Word.**  64 bits: 4 bits of selector on top, 60 bits of payload.  Selector ``s``
packs ``COUNTS[s]`` ids of ``WIDTHS[s]`` bits, the first in the lowest bits.  ``ESCAPE`` is the
selector for an id of more than 60 bits: its payload is the id's number in the frame's escape list.

**Frame.**  Little-endian; whole documents in ascending id order, closed as soon as
it has ``FRAME_IDS`` ids.  Ids are packed in blocks of ``BLOCK``; no word crosses a block
(the last word of a block is filled up with zeros), and the frame holds each block's first word, so all
blocks are packed and unpacked at once with array operations:

    magic "S8B1" | crc32 of the rest | n_docs | n_ids | n_blocks | n_words | n_escapes  (u32 each)
    doc ids (i64) | null flags (u8) | ids per document (u32)
    first word of each block (u32) | words (u64) | escapes (u64)

**File.**  Frames, each followed by one line feed.  Spark's own text writer puts out the
frames as raw bytes, so its commit protocol covers lost executors and repeated
tasks on any file system that Spark can write.  Files have at most ``frames_per_file``
frames.  Documents are dealt by ranges of their id, so files in (part, file) order have ascending ids.

Text is encoded by the tokenizers library, one run without blanks and line feeds at a
time (neither the normaliser nor the pattern looks across those), with a bounded cache.

Reading gives each document's start (ids of all documents before it): a running count in
the file, plus the ids of the files before it, which come from one row per file.

Edge cases.  Null and empty texts have the end id only.  Null ids come first, in arbitrary
order.  Rows with the same id stand next to each other in arbitrary order.  A
very long text makes one large frame.  An empty table gives files without frames and an
empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm.bpe import WORD_BPE
from cairn.llm.common import ship, table, text_bytes, written
from cairn.session import work_dir

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60)
ESCAPE = 14
BLOCK = 128
FRAME_IDS = 1 << 16
#: Runs whose ids are put together at once (one text at least).
RUNS_AT_ONCE = 1 << 18
#: Marks that are a piece of their own behind a word (any other piece goes to the library as it is).
MARKS = ".,;:!?"
#: A word of Latin-1 letters, perhaps with a mark.
PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,;:!?]?$"
MAGIC = b"S8B1"
HEAD = struct.Struct("<4s6I")
_BITS16 = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    bits = _BITS16[(ids & np.uint64(0xFFFF)).astype(np.intp)]
    for shift in (16, 32, 48):
        high = ids >> np.uint64(shift)
        if not high.any():
            break
        part = _BITS16[(high & np.uint64(0xFFFF)).astype(np.intp)]
        bits = np.where(part > 0, part + np.uint8(shift), bits)
    return bits


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, escapes."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + max(COUNTS)), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = np.zeros(grid.shape, np.uint8)
    bits[:, :BLOCK] = bit_lengths(flat).reshape(blocks, BLOCK)
    # The densest selector that fits at each place: ``most`` is the greatest width of
    # the next 1, 2, ... ids, extended by one id at a time.
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    most = bits[:, :BLOCK].copy()
    selector = {COUNTS[s]: s for s in range(ESCAPE)}
    for count in range(1, max(COUNTS) + 1):
        if count > 1:
            np.maximum(most, bits[:, count - 1:count - 1 + BLOCK], out=most)
        if count in selector:
            fits = most <= WIDTHS[selector[count]]
            if not fits.any():
                break
            choice[fits] = selector[count]
    # Follow the choices through all blocks at once.
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    step = np.array(COUNTS)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    rows, places = [], []
    while len(row):
        rows.append(row)
        places.append(at)
        at = at + step[choice[row, at]]
        on = at < size[row]
        row, at = row[on], at[on]
    rows_, places_ = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(rows_, kind="stable")
    rows_, places_ = rows_[order], places_[order]
    chosen = choice[rows_, places_]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        sel = np.nonzero(chosen == s)[0]
        if s == ESCAPE:
            words[sel] |= np.arange(len(sel), dtype=np.uint64)
            continue
        r, p = rows_[sel], places_[sel]
        payload = np.zeros(len(sel), np.uint64)
        for k in range(COUNTS[s]):
            payload |= grid[r, p + k] << np.uint64(k * WIDTHS[s])
        words[sel] |= payload
    escaped = chosen == ESCAPE
    return (words, np.searchsorted(rows_, np.arange(blocks)).astype(np.uint32),
            grid[rows_[escaped], places_[escaped]])


def unpack(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    blocks = len(first)
    if not blocks:
        return np.empty(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[chosen]
    before = np.cumsum(counts) - counts
    row = np.repeat(np.arange(blocks), np.diff(np.append(first.astype(np.int64), len(words))))
    place = before - before[first.astype(np.int64)][row]
    grid = np.zeros((blocks, BLOCK + max(COUNTS)), np.uint64)
    for s in np.unique(chosen).tolist():
        sel = np.nonzero(chosen == s)[0]
        payload = words[sel] & np.uint64((1 << 60) - 1)
        r, p = row[sel], place[sel]
        if s == ESCAPE:
            grid[r, p] = escapes[payload.astype(np.int64)]
            continue
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            grid[r, p + k] = (payload >> np.uint64(k * WIDTHS[s])) & mask
    return grid[:, :BLOCK].reshape(-1)[:n]


def frame(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    words, first, escapes = pack(ids)
    body = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(sizes, "<u4").tobytes(), first.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
        escapes.astype("<u8").tobytes()])
    rest = struct.pack("<5I", len(doc_ids), len(ids), len(first), len(words), len(escapes)) + body
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def frames(content: bytes):
    """The frames of a file: (doc ids, sizes, ids)."""
    at, view = 0, memoryview(content)
    while at < len(content):
        magic, crc, n_docs, n_ids, n_blocks, n_words, n_escapes = HEAD.unpack_from(content, at)
        begin = at + HEAD.size
        ends = np.cumsum([begin, 8 * n_docs, n_docs, 4 * n_docs, 4 * n_blocks, 8 * n_words, 8 * n_escapes]).tolist()
        if magic != MAGIC or crc != zlib.crc32(view[at + 8:ends[-1]]) or content[ends[-1]:ends[-1] + 1] != b"\n":
            raise ValueError(f"no whole frame at byte {at}")
        cut = [view[a:b] for a, b in zip(ends, ends[1:])]
        ids = np.frombuffer(cut[0], "<i8").tolist()
        null = np.frombuffer(cut[1], "u1").tolist()
        tokens = unpack(np.frombuffer(cut[4], "<u8"), np.frombuffer(cut[3], "<u4"), np.frombuffer(cut[5], "<u8"), n_ids)
        yield [None if x else d for d, x in zip(ids, null)], np.frombuffer(cut[2], "<u4").tolist(), tokens
        at = ends[-1] + 1


class Recent:
    """A bounded cache for batches: ``young`` takes what a batch needs; before a batch,
    if it is half full, it becomes ``old``, from which later batches take what they need again."""

    def __init__(self, cap: int):
        self.half, self.young, self.old = cap // 2, {}, {}

    def missing(self, keys: set) -> list:
        """Make the keys' values ready in ``young``; returns those that aren't there."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old.get
        out = []
        for key in keys.difference(young):
            value = old(key)
            if value is None:
                out.append(key)
            else:
                young[key] = value
        return out


class LibraryEncoder:
    """The tokenizers library behind bounded caches of words and of other runs.

    Words that the cache lacks go to the library many at a time, with blanks
    between: a blank ends a word, and the last token of a word carries the end mark, which
    tells the words' tokens apart again."""

    def __init__(self, path: str, cache: int = 800_000, together: int = 500):
        self.library, self.together = Tokenizer.from_file(path), together
        self.ends = {i for t, i in self.library.get_vocab().items() if t.endswith("</w>")}
        self.runs, self.words = Recent(cache), Recent(cache)

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _packed(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes()

    def _words(self, words: list[str]):
        """Pairs of word and ids; ``words`` are letters only."""
        for at in range(0, len(words), self.together):
            some = words[at:at + self.together]
            ids = self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ends = [i + 1 for i, x in enumerate(ids) if x in self.ends]
            if len(ends) == len(some):
                packed = array("I", ids).tobytes()
                yield from ((w, packed[4 * a:4 * b]) for w, a, b in zip(some, [0, *ends], ends))
            else:
                yield from ((w, self._packed(w)) for w in some)

    def _of_words(self, words: list[str]) -> list[bytes]:
        fresh = self.words.missing(set(words))
        self.words.young.update(self._words(fresh))
        return list(map(self.words.young.__getitem__, words))

    def _of_others(self, runs: list[str]) -> list[bytes]:
        missing, known = self.runs.missing(set(runs)), self.runs.young
        known.update((run, self._packed(run)) for run in missing)
        out = list(map(known.__getitem__, runs))
        for run in missing:
            if len(run) > 64:  # hardly comes again
                del known[run]
        return out

    def _distinct(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct runs, one after the other, and their numbers.

        Latin-1 letters, perhaps with one mark at the end, are the word in lower case and that mark."""
        plain = pc.match_substring_regex(runs, PLAIN)
        where = plain.to_numpy(zero_copy_only=False)
        marked = runs.filter(plain)
        words = pc.utf8_lower(pc.utf8_rtrim(marked, MARKS)).dictionary_encode()
        pieces = [b"", *map(self._packed, MARKS), *self._of_words(words.dictionary.to_pylist()),
                  *self._of_others(runs.filter(pc.invert(plain)).to_pylist())]
        # Two pieces a run: its word and its mark, or the run as it is and nothing.
        of = np.zeros((len(runs), 2), np.int64)
        of[where, 0] = words.indices.to_numpy() + 1 + len(MARKS)
        of[~where, 0] = np.arange(1 + len(MARKS) + len(words.dictionary), len(pieces))
        ends = np.zeros(len(marked), np.int64)
        for i, mark in enumerate(MARKS):
            ends[pc.ends_with(marked, mark).to_numpy(zero_copy_only=False)] = i + 1
        of[where, 1] = ends
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        ids, stops = put_together(of.reshape(-1), np.frombuffer(b"".join(pieces), "<u4"), sizes)
        return ids, np.diff(stops[::2])

    def encode(self, texts) -> list[bytes]:
        """Ids of each text (a list of them, or an Arrow column).

        Each distinct run of the batch is looked up once; the ids of all runs are then put together by array operations."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(column.cast(pa.string()), "\n", " "), " ")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        ids, sizes = self._distinct(coded.dictionary)
        codes = coded.indices.to_numpy()
        out, at, first = [], 0, first - first[0]
        while at < len(column):  # some texts at a time, so that their places take little memory
            stop = max(at + 1, int(np.searchsorted(first, first[at] + RUNS_AT_ONCE, "right")) - 1)
            found, ends = put_together(codes[first[at]:first[stop]], ids, sizes)
            raw, cuts = found.tobytes(), (4 * ends[first[at:stop + 1] - first[at]]).tolist()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            at = stop
        return out


def put_together(codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces ``codes``, one after the other, and where each ends (after a 0); ``ids`` has
    the pieces in order, of ``sizes``."""
    length = sizes[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    place = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], length)
    place += np.arange(ends[-1])
    return ids[place], ends


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", frames_per_file: int = 128) -> None:
    """Encode every text, append ``end_id``, and write the frames below ``out``."""
    ship(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def rows(batches):
        enc = encoder(tokenizer)
        ids, parts, size = [], [], 0
        for batch in batches:
            for doc_id, part in zip(batch.column("id").to_pylist(), enc.encode(batch.column("content"))):
                part += end
                ids.append(doc_id)
                parts.append(part)
                size += len(part) // 4
                if size >= FRAME_IDS:
                    yield one(ids, parts)
                    ids, parts, size = [], [], 0
        if ids:
            yield one(ids, parts)

    def one(ids, parts):
        tokens = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array([frame(ids, [len(p) // 4 for p in parts], tokens)], pa.binary())],
                                          names=["value"])

    (docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("content"))
         .repartitionByRange("id").sortWithinPartitions("id").mapInArrow(rows, "value binary")
         .select(F.col("value").cast("string").alias("value"))
         .write.option("maxRecordsPerFile", frames_per_file).option("lineSep", "\n").text(out))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: its file's place (``part, file``), ``before`` (ids in the file before
    it), ``id``, ``n_tokens`` and ``tokens`` (little-endian unsigned 32-bit integers)."""
    return _scan(spark, path, lambda part: part.tobytes(), pa.binary(), "tokens binary")


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tokens`` with ``crc32`` of the ids' bytes in place of the ids."""
    return _scan(spark, path, zlib.crc32, pa.int64(), "crc32 bigint")


def _scan(spark: SparkSession, path: str, of, kind, column: str) -> DataFrame:
    ship(spark)
    name = column.split(" ")[0]

    def rows(batches):
        for batch in batches:
            for part, file, content in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(),
                                           batch.column("content")):
                before = 0
                for doc_ids, sizes, tokens in frames(content.as_py()):
                    ends = np.cumsum(sizes).tolist()
                    small = tokens.astype("<u4")
                    cols = [small[e - n:e] for e, n in zip(ends, sizes)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part] * len(sizes), pa.int64()), pa.array([file] * len(sizes), pa.int64()),
                        pa.array([before + e - n for e, n in zip(ends, sizes)], pa.int64()),
                        pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([of(c) for c in cols], kind)],
                        names=["part", "file", "before", "id", "n_tokens", name])
                    before += ends[-1]

    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("bigint").alias("part"),
        F.regexp_extract("path", r"-c(\d+)\.[^/]*$", 1).cast("bigint").alias("file"), "content")
    return files.mapInArrow(rows, f"part bigint, file bigint, before bigint, id bigint, n_tokens bigint, {column}")


def with_start(rows: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before.  One row per file is summed in
    file order; the documents get their file's sum by a join."""
    files = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("offset", F.coalesce(F.sum("ids").over(order), F.lit(0))).drop("ids")
    return rows.join(files, ["part", "file"]).withColumn("start", F.col("offset") + F.col("before"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "token_files")
    write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path(WORD_BPE), end_id=2)
    rows = written(read_sums(spark, out), "token_sums")
    return with_start(rows).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))
