"""Operator 2, quality by importance resampling.

Two generative models of hashed n-grams are fitted: one of *target* text (labelled good), one
of *raw* text (all documents).  A document's importance weight is the ratio of
the two probabilities of its n-grams; ``log_weight`` is its logarithm.  Documents are
then resampled without replacement by Gumbel top-k: each gets ``key = log_weight +
Gumbel noise`` and the ``k`` greatest keys stay.

* Tokens are runs of letters and digits and runs of marks, in lower case; a token that repeats
  the one before it becomes the one token "again".  Features are unigrams and bigrams, hashed to ``2**BITS``.
* The raw model counts all documents.  The target model counts the good ones in a
  sample of at most ``label_rows`` labelled rows (the least hashes of their ids); half of the
  sample is kept out to choose where the weight parts good from bad.
* ``k`` is the number of documents whose log weight is at or above that cut.  The
  noise is a function of the id and the seed, so a run can be repeated.

Scale.  Each task counts into two arrays of ``2**BITS`` numbers and sends them in slices; the
slices are added up streaming.  What is broadcast is one array of ``2**BITS`` log ratios
(4 MB), whatever the input.  The k-th key is found by histograms (a few thousand
counts at a time), so nothing is sorted.  Documents are read once to count and once to score, and are never shuffled.

Edge cases.  Null and empty text has no features and weight 0.  Ties at the k-th key
all stay.  A null id has its own noise.  Repeated rows get the same key and stay or go
together.  Without labels of both kinds the cut is 0.  An empty table gives an
empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import hashing
from cairn.llm.common import ship, table, text_bytes, written

BITS = 20
SLICES = 64
#: Bound of the labelled sample.
LABEL_ROWS = 20_000
#: Hash of the token that stands for a repeat of the token before.
AGAIN = np.uint64(0xA5A5A5A55A5A5A5A)


def features(words: hashing.Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, and the first of each text."""
    h, first = words.tokens(data, offsets)
    n = len(h)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    again = np.zeros(n, bool)
    again[1:] = (h[1:] == h[:-1]) & ~begins[1:n]
    h = h.copy()
    h[again] = AGAIN
    pair = np.zeros(n, np.uint64)
    pair[1:] = hashing.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    # A unigram at 2i and the bigram that ends there at 2i + 1; texts' first tokens have none.
    both = np.empty(2 * n, np.uint64)
    both[0::2], both[1::2] = h, pair
    has = np.ones(2 * n, bool)
    has[1::2] = ~begins[:n]
    at = np.concatenate([[0], np.cumsum(has)])[2 * first]
    return (both[has] >> np.uint64(64 - BITS)).astype(np.int64), at


def label_sample(labels: DataFrame, id_col: str, label_rows: int) -> dict[int, bool]:
    """id -> good of at most ``label_rows`` labelled rows, those of least hash.  Ids
    labelled both ways count as bad."""
    rows = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
                  .groupBy(F.col(id_col).cast("bigint").alias("id"))
                  .agg(F.min((F.col("quality") > 0) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"),
                       F.min(F.col("quality") > 0).alias("fine"))
                  .orderBy(F.xxhash64("id"), "id").limit(label_rows).collect())
    # Toxic rows of good quality take no part: neither target nor bad.
    return {r.id: r.good for r in rows if r.good or not r.fine}


def fit_half(i: int) -> bool:
    """Whether a labelled id is for the target model (else for the cut)."""
    return (i * 0x9E3779B97F4A7C15 >> 17) % 2 == 0


def count_features(docs: DataFrame, target: set[int]) -> np.ndarray:
    """Array (2, 2**BITS): raw and target counts.  ``docs``: id, content."""
    spark = docs.sparkSession
    ids_ = spark.sparkContext.broadcast(np.array(sorted(target), np.int64))
    size, width = 1 << BITS, (1 << BITS) // SLICES

    def count(batches):
        words = hashing.Words(hashing.word_mark_classes())
        wanted = ids_.value
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            chosen = np.isin(ids, wanted)
            for row, n, data, offsets in hashing.runs(batch.column("content")):
                f, at = features(words, data, offsets)
                raw += np.bincount(f, minlength=size)
                for i in np.flatnonzero(chosen[row:row + n]).tolist():
                    np.add.at(good, f[at[i]:at[i + 1]], 1)
        if raw.any():
            for s in range(SLICES):
                cut = slice(s * width, (s + 1) * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([raw[cut].astype("<i8").tobytes()], pa.binary()),
                     pa.array([good[cut].astype("<i8").tobytes()], pa.binary())], names=["slice", "raw", "good"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw, good in zip(batch.column("slice").to_pylist(), batch.column("raw"), batch.column("good")):
                have = sums.setdefault(s, np.zeros((2, width), np.int64))
                have[0] += np.frombuffer(raw.as_py(), "<i8")
                have[1] += np.frombuffer(good.as_py(), "<i8")
        for s, have in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([have.tobytes()], pa.binary())],
                                             names=["slice", "sums"])

    rows = (docs.mapInArrow(count, "slice int, raw binary, good binary").repartition(SLICES, "slice")
                .mapInArrow(add, "slice int, sums binary").collect())
    out = np.zeros((2, size), np.int64)
    for r in rows:
        out[:, r["slice"] * width:(r["slice"] + 1) * width] += np.frombuffer(bytes(r["sums"]), np.int64).reshape(2, width)
    return out


def log_ratios(counts: np.ndarray, prior: float = 2.0) -> np.ndarray:
    """log(target / raw) per feature: target count over the count to expect if
    target text were raw text, both with ``prior`` added, so that a feature too rare to tell counts little.
    One is taken off the raw count, the scored document's own occurrence: else
    every rare word of a clean document would speak against it."""
    raw, good = counts.astype(float)
    if not raw.sum() or not good.sum():
        return np.zeros(len(raw), np.float32)
    expected = np.maximum(raw - 1, 0) * (good.sum() / raw.sum())
    return np.log((good + prior) / (expected + prior)).astype(np.float32)


def gumbel(ids: np.ndarray, null: np.ndarray, seed: int) -> np.ndarray:
    u = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    u[null] = np.uint64(0xD1B54A32D192ED03) ^ np.uint64(seed)
    unit = ((hashing.mix(hashing.mix(u)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return -np.log(-np.log(unit))


class Scorer:
    """Log weights and keys of texts under broadcast log ratios."""

    def __init__(self, ratios, seed: int):
        self.ratios, self.seed = ratios, seed

    def __call__(self, ids: pa.Array, content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ratio = self.ratios.value
        words = hashing.Words(hashing.word_mark_classes())
        weight = np.zeros(len(content))
        for row, n, data, offsets in hashing.runs(content):
            f, at = features(words, data, offsets)
            total = np.concatenate([[0.0], np.cumsum(ratio[f], dtype=float)])
            weight[row:row + n] = total[at[1:]] - total[at[:-1]]
        # Sums in another order may differ in the last digits; a run's keys must not.
        weight = np.round(weight, 4)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return weight, weight + gumbel(plain, null, self.seed)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    def rows(batches):
        for batch in batches:
            weight, key = scorer(batch.column("id"), batch.column("content"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(weight), pa.array(key)],
                                             names=["id", "log_weight", "key"])

    return docs.mapInArrow(rows, "id bigint, log_weight double, key double")


def best_cut(weights: list[tuple[float, bool]]) -> float:
    """The weight that parts good from bad with the least sum of both error
    rates: of equal cuts the lowest, and half-way to the next sample below it."""
    good = np.sort([w for w, g in weights if g])
    bad = np.sort([w for w, g in weights if not g])
    if not len(good) or not len(bad):
        return 0.0
    cuts = np.unique(np.concatenate([good, bad]))
    errors = np.searchsorted(good, cuts, "left") / len(good) + 1 - np.searchsorted(bad, cuts, "left") / len(bad)
    at = int(np.argmin(errors))
    return float(cuts[at] if at == 0 else (cuts[at - 1] + cuts[at]) / 2)


def kth_greatest(rows: DataFrame, col: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The exact k-th greatest value, by counts per bin of ever smaller ranges."""
    low, high = rows.agg(F.min(col), F.max(col)).first()
    above = 0
    while True:
        inside = rows.where(F.col(col).between(low, high))
        step = (high - low) / bins
        if low == high or step == 0 or low + step == low or high - step == high:
            return low if low == high else _last(inside, col, k - above)
        at = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).alias("bin")
        counts = {r["bin"]: (r["n"], r["lo"], r["hi"]) for r in
                  inside.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            n, low, high = counts[b]
            if above + n >= k:
                break
            above += n
        if n <= few:
            return _last(rows.where(F.col(col).between(low, high)), col, k - above)


def _last(rows: DataFrame, col: str, k: int) -> float:
    values = rows.groupBy(col).count().collect()
    for value, n in sorted(((r[0], r[1]) for r in values), reverse=True):
        k -= n
        if k <= 0:
            return value
    raise ValueError("fewer rows than k")


class Resampler:
    """Fitted models and the cut of one corpus."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_rows: int = LABEL_ROWS, seed: int = 1, k: int | None = None):
        spark = docs.sparkSession
        ship(spark)
        sample = label_sample(labels, "doc_id", label_rows)
        base = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("content"))
        ratios = log_ratios(count_features(base, {i for i, good in sample.items() if good and fit_half(i)}))
        self.scorer = Scorer(spark.sparkContext.broadcast(ratios), seed)
        self.scored = written(score(base, self.scorer), "quality_scores")
        kept_out = [i for i in sample if not fit_half(i)]
        ids = spark.createDataFrame([(i,) for i in kept_out], "id bigint")
        weights = [(r.log_weight, sample[r.id]) for r in self.scored.join(F.broadcast(ids), "id").collect()] if kept_out else []
        self.cut = best_cut(weights)
        self.k = self.scored.where(F.col("log_weight") >= self.cut).count() if k is None else k
        self.least = kth_greatest(self.scored, "key", self.k) if 0 < self.k <= self.scored.count() else (
            float("inf") if self.k <= 0 else float("-inf"))

    def result(self) -> DataFrame:
        return self.scored.withColumn("kept", F.col("key") >= F.lit(self.least))

    def keep_rows(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that stay, columns unchanged: they are scored again
        where they are read, which costs less than a join of all texts."""
        scorer, least = self.scorer, self.least

        @F.arrow_udf("boolean")
        def stays(ids: pa.Array, content: pa.Array) -> pa.Array:
            return pa.array(scorer(ids, content)[1] >= least)

        return docs.where(stays(F.col(id_col).cast("bigint"), text_bytes(text_col)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Resampler(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return fitted.result().select(F.col("id").alias("doc_id"), "log_weight", "key", "kept")
