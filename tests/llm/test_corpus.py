"""Operators 2, 6 and 7, and the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import components, hashing, katz, ngram_join, quality
from tests.llm.conftest import TEXTS, write_tables

SYLLABLES = ["ka", "lo", "mi", "ne", "ru", "ta", "vo", "xi", "sun", "der"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n))


# -- hashing ---------------------------------------------------------------------

def test_hashes_tell_words_apart(monkeypatch):
    monkeypatch.setattr(hashing, "WINDOW", 64)
    monkeypatch.setattr(hashing, "RUN_BYTES", 100)
    raws = [None if t is None else t.encode() for t in TEXTS]
    words, seen = hashing.Words(hashing.word_classes()), {}
    for column in (pa.array(raws, pa.binary()), pa.array(raws * 2, pa.binary()).slice(5, 10)):
        rows = column.to_pylist()
        for row, n, data, offsets in hashing.runs(column):
            h, first = words.tokens(data, offsets)
            for i in range(n):
                want = (rows[row + i] or b"").lower().split()
                got = h[first[i]:first[i + 1]].tolist()
                assert len(want) == len(got)
                assert all(seen.setdefault(w, x) == x for w, x in zip(want, got))
    assert len(set(seen.values())) == len(seen)


# -- 6: n-gram join --------------------------------------------------------------

def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a == b or (x and y and 100 * len(x & y) >= 75 * len(x | y)):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {(i, len(s), find(i)) for i, s in sets}


def near_copies(seed, groups=12, size=9):
    rnd = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        words = prose(rnd, rnd.choice([3, 6, 12, 40, 90])).split()
        for _ in range(size):
            w = list(words)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = prose(rnd, 1)
            if rnd.random() < 0.3:
                w += prose(rnd, rnd.randint(1, 8)).split()
            if rnd.random() < 0.2:
                words = w  # drift: chains of links
            rows.append((i, " ".join(w)))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,chunk", [(1, 1000), (2, 3), (3, 1)])
def test_components_match_all_pairs(spark, seed, chunk):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, chunk=chunk).collect()}
    assert got == brute_components(rows)


def from_stock(seed, n, sentences, per_text=12):
    """Texts put together from a common stock of sentences, some of them near copies of another."""
    rnd = random.Random(seed)
    stock = [prose(rnd, 12) for _ in range(sentences)]
    texts = [rnd.sample(stock, per_text) for _ in range(n)]
    for i in range(0, n, 20):
        texts[i] = texts[rnd.randrange(n)][:]
        texts[i][-1] = prose(rnd, 12)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_sets_of_a_large_group_visit_only_chunks_with_candidates(spark):
    rows = from_stock(4, 500, 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, chunk=40).collect()}
    assert got == brute_components(rows) and len({x[2] for x in got}) < 500
    prefix = spark.createDataFrame([(1, 10), (1, 20), (2, 20), (2, 30), (3, 40)], "g bigint, set_key bigint")
    known = spark.createDataFrame([(1, c, k) for k, c in ((10, 0), (20, 1), (30, 2), (40, 3))], "comp int, chunk int, set_key bigint").withColumn("own", F.lit(True))
    visits = ngram_join.hosted(known, known, prefix).collect()
    assert {(r.set_key, r.chunk) for r in visits} == {(10, 1), (20, 0), (20, 2), (30, 1)} and not any(r.own for r in visits)


def test_exactly_three_quarters_links(spark):
    words = [f"w{i}" for i in range(16)]
    a = " ".join(words[:11])       # 7 shingles
    b = " ".join(words[:13])       # 9, sharing 7: 77 %
    c = " ".join(words[:10]) + " z"  # 6 of a's: 6 / 8 = 75 %
    d = " ".join(words[:16])       # 12, sharing 9 with b: 75 %
    rows = [(4, a), (3, b), (2, c), (1, d), (0, " ".join(words[3:9]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_components(rows) and {x[2] for x in got} == {0, 1}


def test_trie_walk_finds_every_component():
    rnd = np.random.default_rng(5)
    for _ in range(40):
        base = np.unique(rnd.integers(0, 1000, 40)).astype(np.uint64)
        sets = []
        for _ in range(25):
            keep = base[rnd.random(len(base)) < rnd.choice([1.0, 0.95, 0.8, 0.5])]
            extra = rnd.integers(0, 1000, rnd.integers(0, 6)).astype(np.uint64)
            if len(s := np.unique(np.concatenate([keep, extra]))):
                sets.append(s)
        trie = ngram_join.Trie()
        for s in sets:
            doc = trie.add(len(s))
            trie.walk(doc, s)
            trie.insert(doc, s)
        linked = {frozenset(p) for p in trie.links}
        for a, b in itertools.combinations(range(len(sets)), 2):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            similar = 100 * len(x & y) >= 75 * len(x | y)
            assert not similar or trie.find(a) == trie.find(b)
            assert similar or frozenset((a, b)) not in linked


def test_join_of_awkward_rows(awkward, empty):
    rows = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in awkward.collect()]
    want = {(None if i == -1 else i, n, None if c == -1 else c) for i, n, c in brute_components(rows)}
    got = ngram_join.near_duplicates(awkward).collect()
    assert len(got) == len(rows) and {(r.id, r.n_shingles, r.component_id) for r in got} == want
    assert ngram_join.near_duplicates(empty).count() == 0


def test_common_ngrams_are_salted_without_changing_the_result(spark, monkeypatch):
    rnd = random.Random(8)
    passage = prose(rnd, 30)
    rows = [(i, prose(rnd, 5) + " " + passage + " " + prose(rnd, rnd.choice([1, 2, 60]))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    base = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))
    monkeypatch.setattr(ngram_join, "SAMPLE_DOCS", 100)
    assert len(ngram_join.common_ngrams(base, 120)) >= 20
    got = {(r.id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_a_bucket_is_sorted_in_pieces_of_bounded_size(monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE_ENTRIES", 500, raising=False)
    rng = np.random.default_rng(5)
    parts, held = [], defaultdict(set)
    for _ in range(30):
        t = np.sort(np.concatenate([rng.integers(0, 1 << 40, 200), rng.integers(0, 40, 60) << 34]).astype(np.uint64))
        keys = np.unique(rng.integers(0, 1 << 62, 20).astype(np.uint64))
        o = rng.integers(0, len(keys), len(t))
        for g, key in zip(t.tolist(), keys[o].tolist()):
            held[g].add(key)
        parts.append({"t": ngram_join.pack_sorted(t), "o": ngram_join.pack(o), "k": ngram_join.pack_sorted(keys)})
    pieces = list(ngram_join.entries(parts))
    assert sum(len(t) for t, _ in pieces) == 30 * 260 and max(len(t) for t, _ in pieces) <= 1500
    got = [row for t, k in pieces for row in zip(*(x.tolist() for x in ngram_join.shared(t, k)))]
    assert sorted(got) == sorted((g, key, len(keys)) for g, keys in held.items() if len(keys) > 1 for key in keys)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(200, 260)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.comp for r in components.components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 200 for i in [*range(200, 260), 500]}}


# -- 2: quality ------------------------------------------------------------------

def corpus(seed, n=400):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(rnd, rnd.randint(30, 120))
        if not good:
            text = " ".join(w + rnd.choice(["***", " |", "!!", "%%%"]) for w in text.split()) if i % 8 else " ".join(
                w for w in text.split()[:12] for _ in range(9))
        docs.append((i, text))
        if i % 2 or i % 8 == 0 or i % 12 == 4:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(1)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    fit = quality.Resampler(d, lab)
    kept = {r.id: r.kept for r in fit.result().collect()}
    labelled = {i for i, _, _ in labels}
    unseen = [i for i in kept if i not in labelled]
    good = [kept[i] for i in kept if i % 4]
    assert np.mean(good) > 0.97
    assert np.mean([kept[i] for i in unseen if i % 4 == 0]) < 0.1
    again = quality.Resampler(d.repartition(7), lab)
    assert {r.id: (r.kept, r.key) for r in again.result().collect()} == {r.id: (r.kept, r.key) for r in fit.result().collect()}
    rows = fit.keep_rows(d)
    assert rows.columns == d.columns and sorted(r.doc_id for r in rows.collect()) == sorted(i for i, k in kept.items() if k)


def test_weights_match_plain_counts(spark):
    docs, labels = corpus(2, 60)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").select(
        F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))
    target = {i for i, q, _ in labels if q}
    counts = quality.count_features(d, target)
    words = hashing.Words(hashing.word_mark_classes())
    want, per = np.zeros((2, 1 << quality.BITS), np.int64), {}
    for i, t in docs:
        col = pa.array([t.encode()], pa.binary())
        (_, _, data, offsets), = hashing.runs(col)
        per[i], _ = quality.features(words, data, offsets)
        for f in per[i]:
            want[0, f] += 1
            want[1, f] += i in target
    assert (counts == want).all()
    ratios = quality.log_ratios(counts)
    got = {r.id: r.log_weight for r in quality.score(d, quality.Scorer(spark.sparkContext.broadcast(ratios), 1)).collect()}
    assert all(abs(got[i] - ratios[f].astype(float).sum()) < 1e-3 for i, f in per.items())


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_greatest_is_exact(spark, k):
    rnd = random.Random(k)
    values = [rnd.choice([rnd.gauss(0, 1), 0.5, 1e9 * rnd.random(), -3.0]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert quality.kth_greatest(df, "x", k, bins=16, few=20) == sorted(values, reverse=True)[k - 1]


def test_gumbel_top_k_samples_by_weight():
    ids = np.arange(200_000)
    g = quality.gumbel(ids, np.zeros(len(ids), bool), 7)
    assert abs(g.mean() - 0.5772) < 0.01 and abs(g.var() - math.pi ** 2 / 6) < 0.03
    weight = np.where(ids % 2 == 0, math.log(3), 0.0)
    top = np.argsort(-(weight + g))[:2000]
    assert abs(np.mean(top % 2 == 0) - 0.75) < 0.03


def test_quality_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (7, 1, None), (8, 0, 1)],
                                   "doc_id bigint, quality int, toxic int")
    fit = quality.Resampler(awkward, labels)
    got = fit.result().collect()
    assert len(got) == awkward.count() and {r.log_weight for r in got if r.id in (0, 1, 2)} == {0.0}
    assert len({(r.key, r.kept) for r in got if r.id == 3}) == 1
    assert fit.keep_rows(awkward).columns == awkward.columns
    assert quality.Resampler(empty, labels).result().count() == 0
    assert quality.Resampler(awkward, labels.limit(0)).result().count() == awkward.count()
    small = quality.Resampler(awkward, labels, k=3)
    assert small.result().where("kept").count() >= 3


# -- 7: language model -----------------------------------------------------------

def brute_katz(rows, named, held):
    c, ends = Counter(), 0
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    for i, w in texts:
        if not held(i):
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    bins = defaultdict(list)
    for x in c.values():
        bins[math.floor(math.log(x) * 64)].append(x)
    least, fits = 1 << 62, 0
    for b in sorted(bins, reverse=True):
        fits += len(bins[b])
        if fits > named:
            break
        least = min(bins[b])
    names = {w for w, x in c.items() if x >= least}
    rare_n, rare_v = sum(x for x in c.values() if x < least), sum(x < least for x in c.values())
    end, rare, start = ("end",), ("rare",), ("start",)
    unigrams = {**{w: c[w] for w in names}, end: ends, rare: rare_n}
    p1 = {e: (x + 1) / (n + len(unigrams)) for e, x in unigrams.items()}
    seqs = {k: [start, *(w if w in names else rare for w in ws), end] for k, (i, ws) in enumerate(texts)}
    pairs = Counter()
    for k, (i, _) in enumerate(texts):
        if not held(i):
            pairs.update(zip(seqs[k], seqs[k][1:]))
    numbers = Counter(pairs.values())
    d = katz.discounts_of(np.array([0, *(numbers[r] for r in range(1, 8))], float))
    after = defaultdict(dict)
    for (h, w), x in pairs.items():
        after[h][w] = x

    def p(w, h):
        seen = after.get(h)
        if not seen:
            return p1[w]
        total = sum(seen.values())
        share = sum(d[min(x, 6)] * x for x in seen.values()) / total
        rest = 1 - sum(p1[e] for e in seen)
        left = max(1 - share, 1 / (total + 1)) if rest > 1e-12 else 0.0
        if w in seen:
            return (1 - left) / share * d[min(seen[w], 6)] * seen[w] / total
        return left / rest * p1[w]

    for h in list(after)[:20]:
        assert abs(sum(p(e, h) for e in p1) - 1) < 1e-9  # exactly normalised
    out = []
    for k, (i, ws) in enumerate(texts):
        score = sum(math.log10(p(b, a)) for a, b in zip(seqs[k], seqs[k][1:]))
        score += sum(math.log10((c[w] + 1) / (rare_n + rare_v + 1)) for w in ws if w not in names)
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in [*(c[w] for w in ws), ends])
        out.append((i, held(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6, (g, w)


@pytest.mark.parametrize("named,hot", [(1000, 5), (40, 2), (3, 512), (0, 0)])
def test_scores_match_brute_force(spark, named, hot):
    rnd = random.Random(named)
    words = [prose(rnd, 1) for _ in range(80)]
    rows = [(i, " ".join(words[min(int(rnd.expovariate(0.08)), 79)] for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    same(katz.katz_scores(docs, named=named, hot_events=hot).collect(), brute_katz(rows, named, held))


@pytest.mark.parametrize("numbered,hot", [(1000, 5), (40, 2), (3, 512), (0, 0)])
def test_scores_without_a_cap_match_brute_force(spark, awkward, numbered, hot):
    rnd = random.Random(numbered + 1)
    words = [prose(rnd, 1) for _ in range(80)]
    rows = [(i, " ".join(words[min(int(rnd.expovariate(0.08)), 79)] for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    rows += [(i % 150, t) for i, t in rows[:9]]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    for docs in (spark.createDataFrame(rows, "doc_id bigint, text string"), awkward):
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        same(katz.katz_scores(docs, hot_events=hot, numbered=numbered).collect(), brute_katz(texts, 10 ** 9, held))


def test_every_word_of_a_large_vocabulary_is_an_event(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(katz.NAMED + 9000)]
    words += words[-8000:]
    rows = [(i, " ".join(words[i::50])) for i in range(50)] + [(50 + i, " ".join(rnd.choices(words, k=300))) for i in range(20)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(katz.katz_scores(docs).collect(), brute_katz(rows, 10 ** 9, held))


def test_held_out_text_is_predicted_better_than_by_the_base(spark):
    rnd = random.Random(3)
    nxt = {s: rnd.sample(SYLLABLES, 2) for s in SYLLABLES}
    rows = []
    for i in range(200):
        w = [rnd.choice(SYLLABLES)]
        while len(w) < 40:
            w.append(rnd.choice(nxt[w[-1]]))
        rows.append((i, " ".join(w)))
    got = katz.katz_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_a_batch_asks_for_each_pair_once(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(i, i % 4 == 0, text.encode()) for i in range(40)], "id bigint, held boolean, content binary").coalesce(1)
    counts = katz.word_counts(docs.where("not held").select("content"))
    vocabulary, _ = katz.vocabulary_of(counts, 30, 1000, 0, False)
    rows = katz.deal(docs, spark.sparkContext.broadcast(vocabulary), 7).where(F.col("kind") == katz.PAIR).collect()
    assert sum(len(katz.unpack(r["keys"])) for r in rows) == 51
    assert [n for r in rows for n in katz.unpack(r["n"]).tolist()] == [30] * 51


def test_scores_of_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    same(katz.katz_scores(awkward, named=5, hot_events=1).collect(), brute_katz(rows, 5, held))
    assert katz.katz_scores(empty).count() == 0
    none = katz.katz_scores(awkward, held=F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) for r in none)


# -- pipeline --------------------------------------------------------------------

def test_pipeline_keeps_what_its_stages_decide(spark, tmp_path):
    import corpus_pipeline
    docs, labels = corpus(4, 200)
    rnd = random.Random(6)
    passage = prose(rnd, 14)
    docs += [(1000, docs[1][1]), (1001, docs[2][1] + " extra"), (1002, docs[3][1] + " " + passage), (1003, None), (1004, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    sf = write_tables(spark, tmp_path, documents=d, labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
                      benchmark=spark.createDataFrame([(0, passage)], "item_id bigint, text string"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    current = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, current, sf)
        if name != "bpe":
            assert rows.columns == current.columns
        rows.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in current.collect()}
    good = {i for i, _ in docs if i % 4 and i < 200}
    assert len(good - left["quality"]) <= 3
    assert 1 not in left["exact_dedup"] and 1000 in left["exact_dedup"] and not {1003, 1004} <= left["exact_dedup"]
    assert 1001 in left["exact_dedup"] and (1001 in left["near_dedup"]) != (2 in left["near_dedup"])
    assert 1002 not in left["decontaminate"]
    assert left["bpe"] == left["decontaminate"] and len(good - left["bpe"]) <= 6
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == left["bpe"]
    bare = write_tables(spark, tmp_path / "bare", documents=d.limit(0), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"),
                        benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, bare).count() == 0
