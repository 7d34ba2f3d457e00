"""Operator 7, language model scoring: a bigram model with Katz backoff.

**Model.**  Events are all words of the training texts, the end of a text, and the class of words never
seen.  With r = count of the pair (h, w) in training text:

    p(w|h) = s(h) d(r) r / c(h)   if r > 0, else  a(h) p(w)
    p(w)   = (c(w) + 1) / (N + events)

d(r) are Good-Turing discounts after Katz for r <= 5 (1 beyond), from the numbers of pairs seen
1..6 times.  a(h) is exact: the probability that the seen pairs leave, over the unigram
probability of the events not seen after h, so p(.|h) sums to one.  Where the seen
pairs would leave less than 1 / (c(h) + 1), as after a word whose pairs are all frequent, s(h) scales them to leave that.

**Tables.**  Word counts are one row per word.  The most frequent words (``NAMED`` at most) have numbers, and their
c, s and a lie in broadcast arrays; that is only a faster way to the same numbers.
All other words are *outside* of the arrays and go by their 64-bit hash.
Texts are read in batches of ``FLUSH_TOKENS`` tokens.  A batch asks for each distinct pair once: pairs of numbered words
of the bucket of their hash, pairs with a word outside of the bucket of that word (of w if it is outside, else of h), where the
word's count is joined.  A question carries the pair's training count in the batch; the bucket adds these up and answers each
batch with the sums, in the order asked, so no document or position travels.  The s and a of contexts outside are asked for and
answered alike.  A batch's events are written once and meet its answers in one task, which scores its texts.
Pairs of the ``HOT`` most frequent events never travel: each task counts them in an array
of fixed size and scores them where it reads the text.  A pair that makes up a third of all tokens is
such a pair.  Broadcast are arrays of ``NAMED`` and ``HOT**2`` numbers (a few MB), whatever the input.

With ``named`` given, at most so many words are events, and the others are one class ("rare"): a rare word goes on
recursively to its class, p(w|rare) = (c(w) + 1) / (N' + V' + 1), with N' tokens and V' words in the class; one share
is for words never seen.

Result per document: ``n_tokens`` (words and one end), ``n_known`` (seen in training), ``train_tokens``,
``base_score`` (add-one unigrams over exact counts) and ``score`` (log10 probability of the text).

Edge cases.  Null and empty texts are one end.  Documents are held out by crc32 of their id as text (null id: empty
text).  Rows with the same id and text are counted each and get the same score.  Without training
text all words are unseen: score and base are still defined.  If Good-Turing's numbers are unfit (a small corpus),
d(r) = (r - 1/2) / r.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import hashing
from cairn.llm.common import ship, table, text_bytes, written
from cairn.llm.ngram_join import groups, pack, pack_sorted, signed, unpack, unpack_sorted

NAMED = 1 << 17
HOT = 512
KATZ_K = 5
FLUSH_TOKENS = 400_000
COUNT_TOKENS = 1_500_000
BUCKET_TOKENS = 2_000_000
ROW_ENTRIES = 500_000
END, START, RARE = 0, 1, 2
FIRST = 3  # number of the most frequent word


class Vocabulary:
    """Numbers of events; words by falling frequency, so the hot events are the lowest numbers.

    Words without a number are the event RARE if there is a class of them, else ``outside`` (past all numbers)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, words: int, docs: int, hot: int = HOT,
                 classed: bool = True):
        order = np.lexsort((hashes, -counts))
        ranked, ranked_counts = hashes[order], counts[order]
        by_hash = np.argsort(ranked)
        self.sorted_hashes, self.number = ranked[by_hash], by_hash + FIRST
        self.size = len(hashes) + FIRST
        self.hot = min(hot + FIRST, self.size)  # events up to this number are hot
        self.docs, self.tokens, self.words = docs, tokens + docs, words + (docs > 0)
        self.rare_tokens = tokens - int(counts.sum())
        self.rare_words = words - len(hashes)
        self.classed, self.outside = classed, RARE if classed else self.size
        self.counts = np.concatenate([[docs, 0, self.rare_tokens if classed else 0], ranked_counts]).astype(float)
        events = (len(hashes) if classed else words) + FIRST - 1  # all but START
        self.mass = self.tokens + events
        self.p = (self.counts + 1) / self.mass
        self.p[START] = 0.0
        self.context = self.counts.copy()
        self.context[END], self.context[START] = 0.0, docs

    def events(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted_hashes):
            return np.full(len(h), self.outside)
        at = np.minimum(np.searchsorted(self.sorted_hashes, h), len(self.sorted_hashes) - 1)
        return np.where(self.sorted_hashes[at] == h, self.number[at], self.outside)

    def stream(self, h: np.ndarray, first: np.ndarray):
        """Events of all tokens (with the ends), each text's length, and the hashes of words without a number."""
        n, texts = len(h), len(first) - 1
        event = np.full(n + texts, END)
        word = np.ones(n + texts, bool)
        word[first[1:] + np.arange(texts)] = False
        event[word] = own = self.events(h)
        return event, np.diff(first) + 1, h[own == self.outside]

    def contexts(self, event: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        context = np.empty_like(event)
        context[1:] = event[:-1]
        context[np.cumsum(lengths) - lengths] = START
        return context

    def codes(self, event: np.ndarray, lengths: np.ndarray, far: np.ndarray):
        """Contexts and events as 64 bits: the number, or outside of the numbers the word's hash."""
        code = event.astype(np.uint64)
        code[event == self.outside] = far + np.where(far < self.size, np.uint64(self.size), np.uint64(0))
        return self.contexts(code, lengths), code


def backoff(context: np.ndarray, seen: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """s and log10 a of contexts with these counts, discounted masses, and unigram probabilities of their seen events."""
    c = np.maximum(context, 1)
    share = seen / c
    left = np.maximum(1 - share, 1 / (c + 1))
    rest = 1 - covered
    left[rest <= 1e-12] = 0.0
    scale = np.where(share > 0, (1 - left) / np.where(share > 0, share, 1.0), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return scale, np.where(share > 0, np.log10(left / rest), 0.0)


class Model:
    """Everything that scoring needs, in arrays of fixed size."""

    def __init__(self, vocabulary: Vocabulary, discounts: np.ndarray, seen: np.ndarray, covered: np.ndarray, hot: np.ndarray):
        v = self.vocabulary = vocabulary
        self.discounts = discounts
        self.scale, self.log_alpha = backoff(v.context, seen, covered)
        with np.errstate(divide="ignore"):
            self.log_p = np.log10(v.p)
        self.hot = self.hot_logs(hot)

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return self.discounts[np.minimum(counts, KATZ_K + 1)] * counts

    def log_pairs(self, context: np.ndarray, event: np.ndarray, counts: np.ndarray) -> np.ndarray:
        back = self.log_alpha[context] + self.log_p[event]
        found = counts > 0
        out = back
        c = context[found]
        out[found] = np.log10(self.scale[c] * self.discounted(counts[found]) / np.maximum(self.vocabulary.context[c], 1))
        return out

    def hot_logs(self, hot: np.ndarray) -> np.ndarray:
        n = hot.shape[0]
        context, event = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
        ok = (context < self.vocabulary.size) & (event < self.vocabulary.size)
        out = np.zeros(n * n)
        out[ok] = self.log_pairs(context[ok], event[ok], hot.reshape(-1)[ok])
        return out


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``c`` over the texts given."""
    def rows(batches):
        words, held, size = hashing.Words(hashing.word_classes()), [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([signed(values), pa.array(counts)], names=["word", "c"])

        for batch in batches:
            for _, _, data, offsets in hashing.runs(batch.column("content")):
                held.append(words.tokens(data, offsets)[0])
                size += len(held[-1])
                if size >= COUNT_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(rows, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary_of(counts: DataFrame, docs: int, named: int, hot: int, classed: bool) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of a numbered word.  Words are numbered from the
    most frequent down, whole steps of a fine scale of counts at a time, while they fit."""
    step = F.floor(F.log(F.col("c").cast("double")) * 64)
    bins = counts.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).collect()
    least, fits = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        fits += r["n"]
        if fits > named:
            break
        least = r["least"]
    top = counts.where(F.col("c") >= least).toArrow()
    hashes = top.column("word").to_numpy().astype(np.int64).view(np.uint64)
    return Vocabulary(hashes, top.column("c").to_numpy(), sum(r["c"] for r in bins), sum(r["n"] for r in bins), docs, hot, classed), least


#: Kinds of rows.  Asked by a batch, of a bucket: pairs of numbered events, pairs of (rare) words outside, pairs of numbered
#: events after words outside, contexts outside.  A batch's events; a task's hot pairs; words with their counts.
PAIR, OUTSIDE, AFTER, CONTEXT, STREAM, HOTS, WORD = range(7)
DEALT = "kind int, bucket int, batch bigint, keys binary, other binary, n binary, events binary, far binary, docs binary"
ASKS = "kind int, bucket int, batch bigint, keys binary, other binary, n binary"


def distinct(key: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct keys (with their other events) are, in order, and the place of each among them."""
    order = np.argsort(key, kind="stable") if other is None else np.lexsort((other, key))
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    if other is not None:
        other = other[order]
        new[1:] |= other[1:] != other[:-1]
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def questions(v: Vocabulary, event: np.ndarray, lengths: np.ndarray, far: np.ndarray):
    """What a batch asks the buckets: kind, where its occurrences are, distinct keys and other events in order of
    bucket and key, and each occurrence's place among them.  Made alike when it asks and when it gets the answers."""
    context, size, hot = v.contexts(event, lengths), v.size, v.hot
    at = np.flatnonzero((context < size) & (event < size) & ~((context < hot) & (event < hot)))
    yield PAIR, at, (context[at] * size + event[at]).astype(np.uint64), None
    if v.classed:
        yield OUTSIDE, np.flatnonzero(event == RARE), far, None
        return
    before, code = v.codes(event, lengths, far)
    at = np.flatnonzero(event == v.outside)
    yield OUTSIDE, at, code[at], before[at]
    after = context == v.outside
    at = np.flatnonzero(after & (event != v.outside))
    yield AFTER, at, before[at], code[at]
    at = np.flatnonzero(after)
    yield CONTEXT, at, before[at], None


def asked(v: Vocabulary, event: np.ndarray, lengths: np.ndarray, far: np.ndarray, buckets: int):
    for kind, at, key, other in questions(v, event, lengths, far):
        if len(at):
            first, place = distinct(key, other)
            bucket = bucket_of(key[first], buckets)
            order = np.argsort(bucket, kind="stable")
            moved = np.empty_like(order)
            moved[order] = np.arange(len(order))
            first = first[order]
            yield kind, at, bucket[order], key[first], None if other is None else other[first], moved[place]


def deal(docs: DataFrame, vocabulary, buckets: int) -> DataFrame:
    """Batches of texts as events, with their questions by bucket: distinct pairs with their training counts in the batch,
    and contexts outside; hot pairs' training counts.  ``docs``: id, held, content.

    A batch has a number of its own (the task's, and its place in the task); as the rows are written before they are used,
    the questions and events of a number are of one and the same batch."""
    def rows(batches):
        v: Vocabulary = vocabulary.value
        words = hashing.Words(hashing.word_classes())
        hot = v.hot
        counts = np.zeros(hot * hot, np.int64)
        number = TaskContext.get().partitionId() << 32
        held_back, size = [], 0

        def flush():
            event, lengths, far, ids, flags = (np.concatenate(x) for x in zip(*held_back))
            held_back.clear()
            train = np.repeat(flags & 1 == 0, lengths)
            context = v.contexts(event, lengths)
            near = (context < hot) & (event < hot) & train
            np.add(counts, np.bincount(context[near] * hot + event[near], minlength=hot * hot), out=counts)
            out = [(STREAM, 0, number, b"", b"", b"", pack(event), pack(far), pack(np.concatenate([lengths.view(np.uint64), ids, flags])))]
            for kind, at, bucket, key, other, place in asked(v, event, lengths, far, buckets):
                n = np.bincount(place[train[at]], minlength=len(key))
                for a, b in spans(bucket):
                    out.append((kind, int(bucket[a]), number, pack_sorted(key[a:b]), b"" if other is None else pack(other[a:b]),
                                pack(n[a:b]) if kind == PAIR or other is not None else b"", b"", b"", b""))
            return batch_of(out)

        for batch in batches:
            ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            flags = (batch.column("held").to_numpy(zero_copy_only=False).astype(bool).astype(np.uint64)
                     + 2 * batch.column("id").is_null().to_numpy(zero_copy_only=False).astype(np.uint64))
            for row, n, data, offsets in hashing.runs(batch.column("content")):
                held_back.append((*v.stream(*words.tokens(data, offsets)), ids[row:row + n], flags[row:row + n]))
                size += len(held_back[-1][0])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    size, number = 0, number + 1
        if size:
            yield flush()
        if counts.any():
            yield batch_of([(HOTS, 0, number, counts.tobytes(), *[b""] * 5)])

    return docs.mapInArrow(rows, DEALT)


def batch_of(rows: list[tuple], names: str = DEALT) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashing.mix(key) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def spans(at: np.ndarray) -> list[tuple[int, int]]:
    """First and past the last of each run of equal values."""
    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else []
    return [*zip(edges[:-1], edges[1:])]


#: Answers (kind of the question; a: training counts, b: counts of words outside), and without a batch the pairs seen in
#: training: in ``keys`` pairs of numbered events, or the contexts of pairs with a word outside; training counts in a, the events' counts in b.
COUNTED = "kind int, bucket int, batch bigint, keys binary, a binary, b binary"


def count(dealt: DataFrame, counts: DataFrame, least: int, vocabulary, buckets: int) -> DataFrame:
    """The pairs seen in training with their counts, and the answers to all questions but those for contexts."""
    def rows(batches):
        v: Vocabulary = vocabulary.value
        for (bucket,), parts in groups(batches, "bucket"):
            words = [p for p in parts if p["kind"] == WORD]
            for kind in (PAIR, OUTSIDE, AFTER):
                uses = [p for p in parts if p["kind"] == kind]
                if not uses:
                    continue
                keys = [unpack_sorted(p["keys"]) for p in uses]
                key, other = np.concatenate(keys), None
                if kind == OUTSIDE and v.classed:
                    c = look_up(words, key)
                    yield answers(uses, kind, bucket, keys, None, c)
                    continue
                if kind != PAIR:
                    other = np.concatenate([unpack(p["other"]) for p in uses])
                n = np.concatenate([unpack(p["n"]) for p in uses]).astype(np.int64)
                for p in uses:
                    p["keys"] = p["other"] = p["n"] = None
                first, place = distinct(key, other)
                r = np.bincount(place, n, len(first)).astype(np.int64)
                key, other = key[first], None if other is None else other[first]
                c = look_up(words, key) if kind == OUTSIDE else v.counts[other.astype(np.int64)] if kind == AFTER else None
                seen = r > 0
                h, times, of = (other if kind == OUTSIDE else key)[seen], r[seen], None if c is None else c[seen]
                if kind == OUTSIDE:
                    order = np.argsort(h, kind="stable")
                    h, times, of = h[order], times[order], of[order]
                for a in range(0, len(h), ROW_ENTRIES):
                    b = a + ROW_ENTRIES
                    yield batch_of([(kind, bucket, None, pack_sorted(h[a:b]), pack(times[a:b]), b"" if of is None else pack(of[a:b]))], COUNTED)
                yield answers(uses, kind, bucket, keys, r[place], c[place] if kind == OUTSIDE else None)

    questions = dealt.where(F.col("kind").isin(PAIR, OUTSIDE, AFTER)).select("kind", "bucket", "batch", "keys", "other", "n")
    both = word_blobs(counts, least, buckets).unionByName(questions)
    return both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rows, COUNTED)


def answers(uses: list[dict], kind: int, bucket: int, keys: list[np.ndarray], r: np.ndarray | None, c: np.ndarray | None) -> pa.RecordBatch:
    stops = np.cumsum([len(k) for k in keys]).tolist()
    return batch_of([(kind, bucket, p["batch"], b"", *(b"" if x is None else pack(x[a:b]) for x in (r, c)))
                     for p, a, b in zip(uses, [0, *stops[:-1]], stops)], COUNTED)


def per_partition(df: DataFrame, size: int, of, slices: int = 16) -> np.ndarray:
    """Sum over all rows of arrays of ``size`` numbers that ``of(batch, array)`` adds to.

    Each task fills one array and sends it in slices, which are added up as they stream in."""
    width, schema = -(-size // slices), "slice int, data binary"

    def rows(batches):
        total, some = np.zeros(width * slices), False
        for batch in batches:
            of(batch, total[:size])
            some = True
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(slices), pa.int32()),
                 pa.array([part.astype("<f8").tobytes() for part in total.reshape(slices, width)], pa.binary())],
                names=["slice", "data"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, cell in zip(batch.column("slice").to_pylist(), batch.column("data")):
                part = np.frombuffer(cell.as_py(), "<f8")
                sums[s] = sums[s] + part if s in sums else part
        for s, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                             names=["slice", "data"])

    out = np.zeros((slices, width))
    for r in df.mapInArrow(rows, schema).repartition(slices, "slice").mapInArrow(add, schema).collect():
        out[r["slice"]] = np.frombuffer(bytes(r["data"]), "<f8")
    return out.reshape(-1)[:size]


def discounts_of(n: np.ndarray) -> np.ndarray:
    """d(0..k+1) from n[r] = number of pairs seen r times, r <= k + 1."""
    r = np.arange(1, KATZ_K + 1)
    plain = (r - 0.5) / r
    d = plain
    if n[1:KATZ_K + 2].all():
        common = (KATZ_K + 1) * n[KATZ_K + 1] / n[1]
        if common < 1:
            turing = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            d = turing if ((turing > 0) & (turing <= 1)).all() else plain
    return np.concatenate([[0.0], d, [1.0]])


def estimate(pairs: DataFrame, vocabulary: Vocabulary, hot: np.ndarray) -> Model:
    """``pairs``: those seen in training, as ``count`` gives them."""
    spark = pairs.sparkSession
    most = KATZ_K + 2

    def numbers(batch, total):
        for cell in batch.column("a"):
            c = unpack(cell.as_py()).astype(np.int64)
            total += np.bincount(np.minimum(c, most), minlength=most + 1)[:most + 1]

    n = per_partition(pairs.select("a"), most + 1, numbers)
    n += np.bincount(np.minimum(hot.reshape(-1), most), minlength=most + 1)[:most + 1]
    d = discounts_of(n)
    size, mass, p = vocabulary.size, vocabulary.mass, spark.sparkContext.broadcast(vocabulary.p)

    def masses(batch, total):
        for kind, *row in zip(batch.column("kind").to_pylist(), *(batch.column(x) for x in ("keys", "a", "b"))):
            key, r = unpack_sorted(row[0].as_py()), unpack(row[1].as_py()).astype(np.int64)
            if kind == PAIR:
                h, own = np.divmod(key.astype(np.int64), size)
                own = p.value[own]
            else:
                near = key < size
                h, r, own = key[near].astype(np.int64), r[near], (unpack(row[2].as_py())[near].astype(float) + 1) / mass
            total[:size] += np.bincount(h, d[np.minimum(r, KATZ_K + 1)] * r, size)
            total[size:] += np.bincount(h, own, size)

    sums = per_partition(pairs.where(F.col("kind").isin(PAIR, OUTSIDE)).select("kind", "keys", "a", "b"), 2 * size, masses)
    k = hot.shape[0]
    seen, covered = sums[:size], sums[size:]
    seen[:k] += (d[np.minimum(hot, KATZ_K + 1)] * hot).sum(axis=1)
    covered[:k] += ((hot > 0) * vocabulary.p[:k]).sum(axis=1)
    return Model(vocabulary, d, seen, covered, hot)


def context_answers(dealt: DataFrame, pairs: DataFrame, discounts: np.ndarray, vocabulary, buckets: int) -> DataFrame:
    """Answers to the questions for contexts outside: log10 a (a) and log10 s / c (b)."""
    def deal_out(batches):
        size, mass = vocabulary.value.size, vocabulary.value.mass
        for batch in batches:
            out = []
            for row in zip(*(batch.column(x) for x in ("keys", "a", "b"))):
                h, r, c = unpack_sorted(row[0].as_py()), unpack(row[1].as_py()).astype(np.int64), unpack(row[2].as_py()).astype(float)
                far = h >= size
                h, r, c = h[far], r[far], c[far]
                contexts, of = np.unique(h, return_inverse=True)
                sums = np.stack([np.bincount(of, x, len(contexts)) for x in (r, discounts[np.minimum(r, KATZ_K + 1)] * r, (c + 1) / mass)])
                at = bucket_of(contexts, buckets)
                order = np.argsort(at, kind="stable")
                contexts, sums, at = contexts[order], sums[:, order], at[order]
                out += [(OUTSIDE, int(at[x]), None, pack_sorted(contexts[x:y]), sums[:, x:y].astype("<f8").tobytes(), b"") for x, y in spans(at)]
            if out:
                yield batch_of(out, COUNTED)

    def rows(batches):
        for (bucket,), parts in groups(batches, "bucket"):
            uses = [p for p in parts if p["kind"] == CONTEXT]
            known = [p for p in parts if p["kind"] != CONTEXT]
            if not uses:
                continue
            contexts, of = np.unique(np.concatenate([np.empty(0, np.uint64), *(unpack_sorted(p["keys"]) for p in known)]), return_inverse=True)
            each = np.concatenate([np.empty((3, 0)), *(np.frombuffer(p["a"], "<f8").reshape(3, -1) for p in known)], axis=1)
            scale, log_alpha = backoff(*(np.bincount(of, x, len(contexts)) for x in each))
            with np.errstate(divide="ignore"):
                log_seen = np.log10(scale) - np.log10(np.maximum(np.bincount(of, each[0], len(contexts)), 1))
            # The place past all contexts is for those never seen.
            log_alpha, log_seen = np.append(log_alpha, 0.0), np.append(log_seen, 0.0)
            out = []
            for p in uses:
                key = unpack_sorted(p["keys"])
                at = np.searchsorted(contexts, key)
                at[np.append(contexts, np.uint64(0))[at] != key] = len(contexts)
                out.append((CONTEXT, bucket, p["batch"], b"", log_alpha[at].astype("<f8").tobytes(), log_seen[at].astype("<f8").tobytes()))
            yield batch_of(out, COUNTED)

    asks = dealt.where(F.col("kind") == CONTEXT).select("kind", "bucket", "batch", "keys", F.lit(b"").alias("a"), F.lit(b"").alias("b"))
    known = pairs.where(F.col("kind").isin(OUTSIDE, AFTER)).mapInArrow(deal_out, COUNTED)
    return asks.unionByName(known).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rows, COUNTED)


SCORED = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score(dealt: DataFrame, answered: DataFrame, model, buckets: int) -> DataFrame:
    """Batches with the answers to their questions, scored text by text."""
    # Questions and their answers are in order of bucket, so the answers of a kind only need to be put together.
    def answer(parts, kind, column, as_doubles=False):
        cells = [p[column] for p in parts if p["kind"] == kind]  # by bucket
        return np.concatenate([np.frombuffer(x, "<f8") if as_doubles else unpack(x) for x in cells])

    def rows(batches):
        m: Model = model.value
        v = m.vocabulary
        hot = v.hot
        log_count = np.append(np.log10(v.counts + 1), 0.0)
        known_event = np.append(v.counts > 0, False).astype(float)
        log_count[v.outside] = known_event[v.outside] = 0.0
        log_size = math.log10(v.tokens + v.words + 1)
        log_mass = math.log10(v.mass)
        log_class = math.log10(v.rare_tokens + v.rare_words + 1) if v.classed else 0.0
        with np.errstate(divide="ignore"):
            log_seen = np.append(np.log10(m.scale) - np.log10(np.maximum(v.context, 1)), 0.0)
        log_alpha = np.append(m.log_alpha, 0.0)
        for _, parts in groups(batches, "batch"):
            stream = next(p for p in parts if p["kind"] == STREAM)
            event, far = unpack(stream["keys"]).astype(np.int64), unpack(stream["a"])
            lengths, ids, flags = unpack(stream["b"]).reshape(3, -1)
            lengths = lengths.astype(np.int64)
            context = v.contexts(event, lengths)
            near = (context < hot) & (event < hot)
            logs = np.where(near, m.hot[np.where(near, context * hot + event, 0)], 0.0)
            base, known = log_count[event], known_event[event]
            if not v.classed:
                # What a context gives to a pair that was seen after it, and to one that was not.
                after_seen, after_other = log_seen[context], log_alpha[context]
            for kind, at, _, _, _, place in sorted(asked(v, event, lengths, far, buckets), key=lambda x: x[0] != CONTEXT):
                if kind == CONTEXT:
                    after_other[at], after_seen[at] = (answer(parts, kind, x, True)[place] for x in "ab")
                    continue
                if kind == OUTSIDE:
                    c = answer(parts, kind, "b").astype(float)[place]
                    base[at], known[at] = np.log10(c + 1), c > 0
                    if v.classed:
                        logs[at] += base[at] - log_class
                        continue
                r = answer(parts, kind, "a").astype(np.int64)[place]
                if kind == PAIR:
                    logs[at] = m.log_pairs(context[at], event[at], r)
                else:
                    log_c = base[at] if kind == OUTSIDE else log_count[event[at]]
                    found = r > 0
                    each = log_c - log_mass + after_other[at]
                    each[found] = np.log10(m.discounted(r[found])) + after_seen[at[found]]
                    logs[at] = each
            begin = np.cumsum(lengths) - lengths
            known, base, logs = (np.add.reduceat(x, begin) for x in (known, base, logs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.view(np.int64), mask=flags & 2 > 0), pa.array(flags & 1 > 0), pa.array(lengths),
                 pa.array(np.round(known).astype(np.int64)), pa.array(base - lengths * log_size), pa.array(logs)],
                names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    streams = dealt.where(F.col("kind") == STREAM).select("kind", "bucket", "batch", F.col("events").alias("keys"),
                                                          F.col("far").alias("a"), F.col("docs").alias("b"))
    both = streams.unionByName(answered)
    return both.repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(rows, SCORED)


def word_blobs(counts: DataFrame, least: int, buckets: int) -> DataFrame:
    """The counts of words without a number, dealt by word."""
    def blobs(batches):
        for batch in batches:
            word = batch.column("word").to_numpy().view(np.uint64)
            c = batch.column("c").to_numpy()
            at = bucket_of(word, buckets)
            order = np.lexsort((word, at))
            word, c, at = word[order], c[order], at[order]
            out = [(WORD, int(at[x]), None, pack_sorted(word[x:y]), b"", pack(c[x:y])) for x, y in spans(at)]
            if out:
                yield batch_of(out, ASKS)

    # Words come in larger batches than texts: sorted by word, a task's rows make few blobs.
    return counts.where(F.col("c") < least).mapInArrow(blobs, ASKS)


def look_up(words: list[dict], key: np.ndarray) -> np.ndarray:
    """The counts of these words in blobs of ``word_blobs``; 0 for words never seen."""
    if not words:
        return np.zeros(len(key))
    word = np.concatenate([unpack_sorted(p["keys"]) for p in words])
    c = np.concatenate([unpack(p["n"]) for p in words]).astype(float)
    order = np.argsort(word)
    word, c = word[order], c[order]
    at = np.minimum(np.searchsorted(word, key), len(word) - 1)
    return np.where(word[at] == key, c[at], 0.0)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", named: int | None = None,
                hot_events: int = HOT, held: Column | None = None, numbered: int = NAMED) -> DataFrame:
    """One row per row of ``docs``: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``numbered`` words at most lie in arrays (no matter for the result); with ``named``, at most so many are events."""
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    held = held_out(F.col(id_col)) if held is None else held
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), held.alias("held"), text_bytes(text_col).alias("content"))
    train = base.where("not held")
    counts = written(word_counts(train.select("content")), "katz_words")
    vocabulary, least = vocabulary_of(counts, train.count(), numbered if named is None else named, hot_events, named is not None)
    voc = sc.broadcast(vocabulary)
    buckets = max(2 * sc.defaultParallelism, math.ceil(vocabulary.tokens / BUCKET_TOKENS))
    dealt = written(deal(base, voc, buckets), "katz_dealt")
    n = vocabulary.hot

    def hot_counts(batch, total):
        for cell in batch.column("keys"):
            total += np.frombuffer(cell.as_py(), np.int64)

    hot = per_partition(dealt.where(F.col("kind") == HOTS).select("keys"), n * n, hot_counts).astype(np.int64).reshape(n, n)
    counted = written(count(dealt, counts, least, voc, buckets), "katz_counted")
    pairs, answered = counted.where("batch is null"), counted.where("batch is not null")
    fitted = estimate(pairs, vocabulary, hot)
    model = sc.broadcast(fitted)
    if not vocabulary.classed:
        answered = answered.unionByName(context_answers(dealt, pairs, fitted.discounts, voc, buckets))
    scored = written(score(dealt, answered, model, buckets), "katz_documents")
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
                         "base_score", "score")


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
