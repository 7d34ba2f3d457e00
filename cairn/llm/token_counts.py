"""Operator 1, token counts by field or section, from one encoding of the whole document.

Encoding each section by itself gives other tokens than encoding the document, since
merges and the split pattern look across the boundary.  Here the document is encoded once.
Each token has a character span, from the character that holds its first byte to
the one that holds its last.  Spans and sections, both in order, are
interval-joined by binary search, and each token's count goes to sections by a rule:

* ``largest``: all to the section that shares most characters with the span, the first of equals;
* ``start``: all to the section of its first character; ``end``: of its last;
* ``split``: to each section in proportion to the characters shared.

Tokens (or the parts of tokens, for ``split``) that no section covers go to section -1,
so a document's counts always add up to its tokens.

Sections are intervals of characters that do not overlap, in ascending order.
``lines_of`` makes one per line (a line ends behind its ``\\n``), and ``field_text`` joins
columns to one text with a section per column.

One pass over the documents, no shuffle; a task holds one Arrow batch (bounded in rows and bytes).

Edge cases.  Null and empty text has no tokens; its one line is an empty section with
count 0.  Sections without characters get 0.  Null sections count as none: all tokens go to section -1.
Repeated rows are counted one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import ship, table, text_bytes

BYTE_BPE = "byte_bpe_50k.tiktoken"
RULES = ("largest", "start", "end", "split")
COUNT_SCHEMA = "id bigint, section bigint, start bigint, stop bigint, n_tokens double, n_crossing bigint"


class SpanEncoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int64)

    def spans(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token of a text."""
        ids = self.ids(raw.decode())
        stop = np.cumsum(self.sizes[ids])
        start = stop - self.sizes[ids]
        if len(ids) == 0 or raw.isascii():
            return start, stop
        char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        return char[start], char[stop - 1] + 1


def attribute(start: np.ndarray, stop: np.ndarray, sec_start: np.ndarray, sec_stop: np.ndarray,
              rule: str) -> tuple[np.ndarray, float, np.ndarray]:
    """Counts per section, count outside of all sections, crossing tokens per
    section.  A token crosses if it shares characters with more than one section."""
    counts = np.zeros(len(sec_start))
    crossing = np.zeros(len(sec_start), np.int64)
    solid = np.nonzero(sec_stop > sec_start)[0]  # sections without characters get nothing
    a, b = sec_start[solid], sec_stop[solid]
    if not len(solid) or not len(start):
        return counts, float(len(start)), crossing
    first = np.searchsorted(b, start, "right")  # the first section that ends behind the token's start
    last = np.searchsorted(a, stop, "left") - 1  # the last one that starts before its end
    length = stop - start

    def shared(sec):
        at = np.clip(sec, 0, len(a) - 1)
        return np.maximum(0, np.minimum(stop, b[at]) - np.maximum(start, a[at]))

    within = first <= last
    whole = np.nonzero(within & (first == last))[0]
    wide = np.nonzero(within & (first < last))[0]
    outside = float(np.count_nonzero(~within))
    add = np.zeros(len(solid))
    for t in wide.tolist():
        crossing[solid[first[t]:last[t] + 1]] += 1
    if rule == "split":
        part = shared(first)[whole] / length[whole]
        np.add.at(add, first[whole], part)
        outside += float(np.sum(1 - part))
        for t in wide.tolist():
            rest = 1.0
            for s in range(first[t], last[t] + 1):
                share = (min(stop[t], b[s]) - max(start[t], a[s])) / length[t]
                add[s] += share
                rest -= share
            outside += max(0.0, rest)
    else:
        target = first.copy()
        covered = within.copy()
        if rule == "start":
            covered &= a[np.clip(first, 0, len(a) - 1)] <= start
        elif rule == "end":
            target = last.copy()
            covered &= b[np.clip(last, 0, len(b) - 1)] >= stop
        else:
            for t in wide.tolist():
                span = np.arange(first[t], last[t] + 1)
                target[t] = span[np.argmax(np.minimum(stop[t], b[span]) - np.maximum(start[t], a[span]))]
        outside += float(np.count_nonzero(within & ~covered))
        add += np.bincount(target[covered], minlength=len(solid))
    counts[solid] = add
    return counts, outside, crossing


_ENCODERS: dict[str, SpanEncoder] = {}


def encoder(path: str) -> SpanEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SpanEncoder(path)
    return _ENCODERS[path]


def field_text(cols: list[str], glue: str = "\n") -> tuple[Column, Column]:
    """One text of several columns (null: empty) and its sections: field i is
    section i, without the glue between fields."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    sections, at = [], F.lit(0).cast("bigint")
    for i, t in enumerate(texts):
        size = F.length(t).cast("bigint")
        sections.append(F.struct(F.lit(i).cast("bigint").alias("section"), at.alias("start"), (at + size).alias("stop")))
        at = at + size + len(glue)
    return F.concat_ws(glue, *texts), F.array(*sections)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: Column | None = None,
                 sections: Column | str = "lines", rule: str = "largest") -> DataFrame:
    """One row per document and section (and section -1 where tokens lie outside
    of all sections): ``id, section, start, stop, n_tokens, n_crossing``.

    ``sections`` is ``"lines"`` or a column of the kind that ``field_text`` makes."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    lines = isinstance(sections, str)
    content = text_bytes("text") if text is None else F.coalesce(text, F.lit("")).cast("binary")
    cols = [F.col(id_col).cast("bigint").alias("id"), content.alias("content")]
    if not lines:
        cols.append(sections.alias("sections"))

    def rows(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            given = None if lines else batch.column("sections").to_pylist()
            out = []
            for i, cell in enumerate(batch.column("content")):
                raw = cell.as_py()
                if lines:
                    name, a, b = lines_of(raw)
                else:
                    secs = given[i] or []
                    name = np.array([s["section"] for s in secs], np.int64)
                    a = np.array([s["start"] for s in secs], np.int64)
                    b = np.array([s["stop"] for s in secs], np.int64)
                counts, outside, crossing = attribute(*enc.spans(raw), a, b, rule)
                if outside > 1e-9:
                    name, a, b = np.append(name, -1), np.append(a, -1), np.append(b, -1)
                    counts, crossing = np.append(counts, outside), np.append(crossing, 0)
                out.append((np.full(len(name), i), name, a, b, counts, crossing))
            if out:
                at, *parts = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()).take(pa.array(at)), *map(pa.array, parts)],
                    names=["id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return docs.select(*cols).mapInArrow(rows, COUNT_SCHEMA)


def lines_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, start and stop (in characters) of each line of a text."""
    data = np.frombuffer(raw, np.uint8)
    breaks = np.nonzero(data == 10)[0] + 1
    if not raw.isascii():
        chars = np.cumsum((data & 0xC0) != 0x80)
        breaks, size = chars[breaks - 1], int(chars[-1])
    else:
        size = len(raw)
    edges = np.concatenate([[0], breaks, [size]]).astype(np.int64)
    return np.arange(len(edges) - 1), edges[:-1], edges[1:]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counts.select(F.col("id").alias("doc_id"), "section", F.col("start").alias("start_char"),
                         F.col("stop").alias("stop_char"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "n_crossing")
