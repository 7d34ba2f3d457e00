"""Operators 8 and 9."""

import random
import time

import numpy as np
import pytest

from cairn.llm import decontaminate as dec
from cairn.llm import licenses as lic


def brute_hits(words, items, span):
    hit, found = set(), set()
    for item, ws in items:
        if not ws:
            continue
        n = min(span, len(ws))
        windows = {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)}
        for p in range(len(words) - n + 1):
            if tuple(words[p:p + n]) in windows:
                hit.update(range(p, p + n))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("vocabulary", [2, 5, 40])
def test_winnowing_misses_no_shared_span(vocabulary):
    rnd = random.Random(vocabulary)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    for _ in range(60):
        items = [(i, [word() for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 25]))]) for i in range(6)]
        texts = []
        for _ in range(8):
            t = [word() for _ in range(rnd.randint(0, 30))]
            if rnd.random() < 0.6:
                ws = rnd.choice(items)[1]
                t += ws[rnd.randint(0, 3):] + [word() for _ in range(5)]
            texts.append(t)
        index = dec.BenchmarkIndex([(i, " ".join(ws).encode()) for i, ws in items])
        got = list(dec.scan((" ".join(t).encode() for t in texts), index, most_words=40))
        for t, (n, runs, found) in zip(texts, got):
            hit, want = brute_hits(t, items, 10)
            assert n == len(t)
            assert {p for a, b in runs for p in range(a, b)} == hit
            assert {index.ids[i] for i in found} == want


def test_words_of_the_contract():
    assert dec.words_of("Äb-C'd 1x\x7f中文\x00ÉÉ _z".encode()) == ["Äb".encode(), b"c", b"d", b"1x", "中文".encode(), "ÉÉ".encode(), b"z"]


def test_contamination_rows_and_blocks(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "one"), (None, "abc"), (3, None), (4, "- ."), (2, "lazy")],
                                  "item_id bigint, text string")
    for block_bytes in (1 << 20, 20):
        got = dec.find_contamination(awkward, bench, block_bytes=block_bytes).collect()
        assert len(got) == awkward.count()
        by = {r.id: r for r in got if r.id is not None}
        assert sorted(by[5].items) == [1, 2] and [tuple(x) for x in by[5].runs] == [(0, 9)]
        assert by[3].items == [2] and by[11].null_item and by[11].items == [] and by[0].n_words == 0
        clean = dec.keep_clean(awkward, bench, block_bytes=block_bytes)
        assert clean.columns == awkward.columns and clean.count() == sum(not r.runs for r in got)
        assert dec.find_contamination(empty, bench, block_bytes=block_bytes).count() == 0
    assert dec.keep_clean(awkward, bench.limit(0)).count() == awkward.count()


def brute_licenses(raw, least):
    bags = [(n, lic.bigrams(lic.words_of(t.encode()))) for n in sorted(lic.TEMPLATES) for t in lic.TEMPLATES[n]]
    out = set()
    for _, _, words in lic.units(raw):
        bag = lic.bigrams(words)
        best = max(lic.dice(bag, b) for _, b in bags)
        if best >= least:
            out.add(min(n for n, b in bags if lic.dice(bag, b) == best))
    return sorted(out)


def test_licences_match_all_templates_without_bounds(spark, awkward, empty):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        name = rnd.choice(sorted(lic.TEMPLATES))
        words = rnd.choice(lic.TEMPLATES[name]).split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = "changed"
        text = " ".join(words)
        if i % 3 == 0:
            text = "Copyright 2020 Some One\n" + text.replace(". ", ".\n") + "\n\nand then some prose of another kind"
        if i % 5 == 0:
            text = text.upper().replace("LICENSE", "LICENCE")
        rows.append((i, "intro line\n" + text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r.licenses for r in lic.scan_licenses(docs).collect()}
    want = {i: brute_licenses(t.encode(), 0.85) for i, t in rows}
    assert got == want and any(want.values()) and not all(want.values())
    assert {tuple(r.licenses) for r in lic.scan_licenses(awkward).collect()} == {()}
    assert lic.scan_licenses(awkward).count() == awkward.count() and lic.scan_licenses(empty).count() == 0


def test_every_template_finds_itself():
    scanner = lic.Scanner(lic.Matcher(lic.TEMPLATES, 0.85))
    for name, texts in lic.TEMPLATES.items():
        for t in texts:
            assert (name, 1.0) in {(n, d) for _, _, n, d in scanner.scan(t.encode())}
    known = lic.Matcher(lic.TEMPLATES, 0.85).known_pairs()
    assert (np.diff(known.astype(float)) > 0).all()


def licences_of(text):
    return {x[2] for x in lic.Scanner(lic.Matcher(lic.TEMPLATES, 0.85)).scan(text.encode())}


def test_notices_of_several_paragraphs_in_other_text(spark):
    header = lic.TEMPLATES["Apache-2.0"][1]
    for cut in ("you may", "You may", "Unless", "WITHOUT"):
        header = header.replace(cut, "\n *\n * " + cut)
    gpl = lic.TEMPLATES["GPL-3.0"][1].replace("This program is dist", "\n\nThis program is dist")
    prose = "\n".join(f"int value{i} = other{i} + {i};" for i in range(300))
    rows = [(1, f"/*\n * Copyright 2020 Some One\n *\n * {header}\n */\n{prose}"), (2, f"{prose}\n{gpl} {prose}"),
            (3, f"{prose}\n\n{header}\n\n{gpl}\n{prose}"), (4, prose)]
    got = {r.id: r for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].licenses for i in (1, 2, 3, 4)] == [["Apache-2.0"], ["GPL-3.0"], ["Apache-2.0", "GPL-3.0"], []]
    assert got[1].best_scope == got[2].best_scope == "window" and got[1].best_line == 3


def test_windows_are_the_best_of_all_windows():
    rnd = random.Random(2)
    matchers = [lic.Matcher({"A": [x]}, 0.85) for x in ("a b c a b d e f a b", "c c d e f g a a")]
    seen = 0
    for _ in range(300):
        words = [rnd.choice("abcdefg").encode() for _ in range(rnd.randint(2, 12))]
        words += rnd.choice(["a b c a b d e f a b", "c c d e f g a a", "a b c a b d f a b", ""]).encode().split() * rnd.randint(1, 2)
        words += [rnd.choice("abcdefg").encode() for _ in range(rnd.randint(0, 6))]
        for m in matchers:
            got, bag = m.windows(words), m.bags[0][1]
            every = [lic.dice(lic.bigrams(words[a:b]), bag) for a in range(len(words)) for b in range(a + 2, len(words) + 1)]
            best = max(every)
            found = max((lic.dice(lic.bigrams(words[a:b]), bag) for a, b in got), default=0.0)
            assert best < 0.85 or abs(found - best) < 1e-12
            seen += best >= 0.85
    assert seen > 50


def test_whole_texts_and_near_neighbours():
    for name, text in lic.TEXTS.items():
        wrapped = "Some Licence\n\nCopyright (c) 2021 Some One\n\n" + text.replace(". ", ".\n\n")
        assert licences_of(wrapped) >= {name}
        assert not licences_of(wrapped) & {"BSD-2-Clause" if name == "BSD-3-Clause" else "BSD-3-Clause"} - {name}
    for kind, name in (("Lesser", "LGPL-3.0"), ("Affero", "AGPL-3.0")):
        assert licences_of(f"This work is licensed under the GNU {kind} General Public License, version 3.") == {name}
    assert licences_of("This work is licensed under the GNU General Public License, version 2.") == {"GPL-2.0"}
    assert not licences_of("This work is licensed under the GNU General Public License, version 4.")
    assert not licences_of("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.")


def all_windows(m, words, k=0):
    """Best window of all, then of both sides of it, by counting."""
    name, bag, size, _ = m.bags[k]
    pairs = list(zip(words, words[1:]))

    def best(x, y):
        found = [(-2 * sum((lic.Counter(pairs[a:b]) & bag).values()) / (b - a + size), a, b)
                 for a in range(x, y) for b in range(a + 1, y + 1)]
        value, a, b = min(found, default=(0, 0, 0))
        return [] if -value < m.least else [*best(x, a), (a, b), *best(b, y)]
    return best(0, len(pairs))


def test_windows_go_on_to_both_sides():
    rnd = random.Random(5)
    several = 0
    for text in ("a b c a b d e f a b", "a a a a b a a", "a b c d e f g"):
        m = lic.Matcher({"A": [text]}, 0.85)
        for _ in range(60):
            words = []
            for _ in range(rnd.randint(1, 4)):
                words += text.split()
                if rnd.random() < 0.5:
                    words[rnd.randrange(len(words))] = rnd.choice("abx")
                words += [rnd.choice("abx") for _ in range(rnd.randint(0, 2))]
            words = [w.encode() for w in words]
            ids = np.array([m.number.get(x, -1) for x in zip(words, words[1:])])
            got = [(a, b) for a, b, _ in m.best_windows(ids, np.argsort(ids, kind="stable"), 0)]
            assert sorted(got) == all_windows(m, words)
            several += len(got) > 1
    assert several > 50


def test_time_goes_linearly_with_the_text():
    scanner = lic.Scanner(lic.Matcher(lic.TEMPLATES, 0.85))

    def seconds(text):
        begin = time.process_time()
        found = scanner.scan(text.encode())
        return time.process_time() - begin, found
    notice = max(lic.TEMPLATES["MIT"], key=len)
    for separator, times in (("\n\n", 640), (" ", 640)):
        few, _ = seconds(separator.join([notice] * (times // 8)))
        many, found = seconds(separator.join([notice] * times))
        assert {x[2] for x in found} == {"MIT"} and many < 10 and many < 16 * max(few, 0.1)
    whole = max(lic.TEMPLATES["GPL-3.0"], key=len)
    spent, found = seconds("\n\n".join([whole] * 8))
    assert spent < 10 and sum(x[2] == "GPL-3.0" for x in found) >= 8
