"""Operator 11 against sums taken term by term, its tree against all pairs of each row, and edge rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import divergence as op


def brute(rows, least=op.LEAST_DOCS, top=op.TOP, scale=op.SCALE):
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        groups[lang, source].update(found)
        seen[lang].update(set(found))
    out = set()
    for lang in {k[0] for k in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def p(c):
            n = sum(c.values())
            return {t: 1 + scale * (c[t] + 1) // (n + len(kept)) for t in kept}

        ps, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s in own:
            pairs = [(h, sum((ps[s][t] - ps[h][t]) ** 2 // ps[h][t] for t in kept)) for h in own if h != s]
            terms = [(t, (ps[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def test_random_tables(spark):
    rng = random.Random(11)
    for size, words in ((0, 5), (40, 30), (300, 120)):
        vocabulary = ["".join(rng.choice("abcXYé\u00df") for _ in range(rng.randrange(1, 5))) for _ in range(words)]
        rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "hot", "hot", "hot", "é", None]),
                 rng.choice(["", " ", "-", "1"]).join(rng.choices(vocabulary, k=rng.randrange(0, 40))) if rng.random() > 0.1 else None)
                for _ in range(size)]
        got = [tuple(r) for r in op.divergence(frame(spark, rows)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_sources_without_kept_terms_and_top(spark):
    rows = [("en", "a", "one two"), ("en", "b", "one"), ("en", "c", None), ("en", "d", "1 2 3"), ("xx", "a", "only"), ("xx", "b", None), ("yy", "a", None)]
    rows += [("en", "a", "one three three two")] * 3
    for top in (1, 200):
        got = [tuple(r) for r in op.divergence(frame(spark, rows), top=top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, top=top)
    assert ("xx", "a", "pair", "b", 0, 1) in got


def test_small_trees_and_flushes_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("en", f"s{rng.randrange(9)}", " ".join(rng.choices(["w%s" % chr(97 + i) for i in range(26)], k=12))) for _ in range(150)]
    stats = op.Stats(frame(spark, rows))
    want = {tuple(r) for r in op.pair_corrections(stats).collect()}
    assert want and {tuple(r) for r in op.pair_corrections(stats, rows_per_tree=3).collect()} == want
    whole = Counter()
    for held in (1, op.HELD):
        monkeypatch.setattr(op, "HELD", held)
        batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["a", "b", "a"], "content": [b"x y X", b"", b"x"]})
        out = Counter()
        for part in op._count([batch]):
            for r in part.to_pylist():
                out[r["source"], r["term"]] += 1000 * r["n"] + r["docs"]
        whole = whole or out
        assert out == whole and out["a", "x"] == 3002 and ("b", "") in out


def test_tree_shares_paths():
    rows = [[1, 2, 3], [1, 2, 3, 4], [1, 2, 5], [1, 6], [2, 3], [2, 3, 4]]
    mult = np.array([2, 1, 5, 1, 1, 3])
    tree = op.Tree(np.array(sum(rows, [])), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), mult)
    assert len(tree.item) == 9
    assert tree.mult.tolist() == [9, 8, 3, 1, 5, 1, 4, 4, 3]
    got = Counter()
    steps = 0
    for nodes, ancestors in tree.pairs():
        steps += len(nodes)
        for n, a in zip(nodes, ancestors):
            got[tree.item[a], tree.item[n]] += tree.mult[n]
    want = Counter()
    for r, m in zip(rows, mult):
        for i, b in enumerate(r):
            for a in r[:i]:
                want[a, b] += m
    assert got == want
    assert steps < sum(len(r) * (len(r) - 1) // 2 for r in rows)


def test_values_beyond_64_bits_inside_the_sums(spark):
    # Counts whose corrections times multiplicities wrap, though the values fit.
    rows = [("en", "a", "zz " * 5000 + " ".join("q" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(600)))] * 3
    rows += [("en", "b", " ".join("q" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(600)))]
    assert {tuple(r) for r in op.divergence(frame(spark, rows)).collect()} == brute(rows)


def test_edge_rows(spark, awkward, empty):
    for df in (awkward, empty):
        docs = df.selectExpr("*", "cast(null as string) AS lang", "`key` AS source", "1 AS term", "2 AS counts", "3 AS total")
        rows = [(r.lang, r.source, r.text) for r in docs.collect()]
        got = [tuple(r) for r in op.divergence(docs).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)
