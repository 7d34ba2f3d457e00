"""Operators 1, 3 and 5."""

import array
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import bpe, token_counts, token_files
from tests.llm.conftest import TEXTS

PATH = public_tokenizers.path(bpe.WORD_BPE)
POOL = ["a", "b", "e", "th", "in", " ", "\n", "é", "É", "À", "µ", "ª", "Σ", "ς", "İ", "'s", "'T", "<|endoftext|>", "<|ENDOFTEXT|>",
        "<|", "😀", "1", "²", "…", "\x00", "\x1c", "\x85", "\xa0", "ß", "ﬁ", "́", "中", "x.", "y!", ".", "..", "\t", "\r\n", "inin"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def ids_of(raw):
    out = array.array("I")
    out.frombytes(raw)
    return out.tolist()


# -- 5: transducer ---------------------------------------------------------------

def test_transducer_equals_the_library(library):
    codec = bpe.WordBpe(PATH, cache=200)
    for s in [*random_texts(5000, 1), *[t for t in TEXTS if t]]:
        ids = codec.encode(s)
        want = library.encode(s, add_special_tokens=False).ids
        assert ids_of(ids) == want, s
        assert "".join(bpe.decoded(codec, ids, step=3)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("pool", ["a", "ab", "ino", "thean"])
def test_long_pieces_stream_in_constant_memory(library, pool):
    merges = bpe.codec(PATH).merges
    rnd = random.Random(2)
    text = "".join(rnd.choice(pool) for _ in range(20_000))
    enc, out, at = bpe.PieceEncoder(merges, chunk=100), [], 0
    while at < len(text):
        n = rnd.randint(1, 900)
        out += enc.feed(text[at:at + n])
        at += n
    out += enc.finish()
    assert out == library.encode(text, add_special_tokens=False).tokens
    assert enc.most <= merges.lookahead + merges.longest + 100


def test_lookahead_is_sufficient_for_random_merge_lists():
    rnd = random.Random(3)
    for _ in range(200):
        tokens, merges = list("ab"), []
        while len(merges) < 8:
            u, v = rnd.choice(tokens), rnd.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        m = bpe.Merges(merges, suffix="")
        s = [rnd.choice("ab") for _ in range(60)]
        whole = np.cumsum([len(t) for t in m.apply(list(s))]).tolist()
        for read in range(1, 60):
            part = np.cumsum([len(t) for t in m.apply(s[:read])]).tolist()
            final = read - m.lookahead
            assert [x for x in part if x <= final] == [x for x in whole if x <= final]


def test_decoder_restores_text_and_holds_back_unfinished_characters():
    codec = bpe.codec(PATH)
    ids = ids_of(codec.encode("naïve 😀 wörld"))
    decoder = bpe.Decoder(codec, restore=True)
    assert "".join([*(decoder.feed([i]) for i in ids), decoder.finish()]) == "naïve 😀 wörld "


def test_round_trip_rows(spark, awkward, empty, library):
    got = bpe.round_trip(awkward, PATH).collect()
    texts = awkward.collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        ids = library.encode(t.text or "", add_special_tokens=False).ids
        assert (r.id, r.n_tokens) == (t.doc_id, len(ids))
        assert r.ids_sha256 == hashlib.sha256(array.array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_documents(awkward, PATH)
    assert bpe.decode_documents(encoded, PATH).count() == len(texts)
    assert bpe.round_trip(empty, PATH).count() == 0


# -- 3: token files --------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("most", [0, 1, 255, 50_000, 2 ** 31, 2 ** 60 - 1])
def test_simple8b_round_trip(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n, dtype=np.uint64, endpoint=True)
    if n > 10:
        ids[[3, 5]] = [2 ** 60, 2 ** 64 - 1]
    words, first, escapes = token_files.pack(ids)
    assert (token_files.unpack(words, first, escapes, n) == ids).all()
    assert len(escapes) == (2 if n > 10 else 0)
    if n > 1000 and most == 1:
        assert len(words) < n / 25


def test_broken_frames_are_found():
    raw = token_files.frame([1, None], [2, 1], np.array([5, 6, 7], np.uint64)) + b"\n"
    assert [(d, s, t.tolist()) for d, s, t in token_files.frames(raw)] == [([1, None], [2, 1], [5, 6, 7])]
    for bad in (raw[:-1], raw[:20] + b"\xff" + raw[21:], b"XXXX" + raw[4:]):
        with pytest.raises(Exception):
            list(token_files.frames(bad))


def test_library_encoder_equals_the_library(library):
    enc = token_files.LibraryEncoder(PATH, cache=300, together=7)
    texts = random_texts(4000, 5)
    for at in range(0, len(texts), 100):
        for s, ids in zip(texts[at:at + 100], enc.encode(texts[at:at + 100])):
            assert ids_of(ids) == library.encode(s, add_special_tokens=False).ids, s


def test_files_hold_all_documents_in_order(spark, awkward, empty, library, tmp_path, monkeypatch):
    out = str(tmp_path / "tokens")
    token_files.write_tokens(awkward, out, PATH, end_id=2, frames_per_file=1)
    rows = token_files.with_start(token_files.read_sums(spark, out)).orderBy("start", "n_tokens").collect()
    texts = awkward.collect()
    want = sorted(((t.doc_id is not None, t.doc_id or 0, [*library.encode(t.text or "", add_special_tokens=False).ids, 2])
                   for t in texts), key=lambda x: x[:2])
    assert [r.id for r in rows] == [i if has else None for has, i, _ in want]
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    sums = sorted((r.id is not None, r.id or 0, r.n_tokens, r.crc32) for r in rows)
    assert sums == sorted((h, i, len(x), zlib.crc32(array.array("I", x).tobytes())) for h, i, x in want)
    back = {r.id: bytes(r.tokens) for r in token_files.read_tokens(spark, out).where("id is not null").collect()}
    assert ids_of(back[6]) == [*library.encode(TEXTS[6], add_special_tokens=False).ids, 2]
    none = str(tmp_path / "none")
    token_files.write_tokens(empty, none, PATH, end_id=2)
    assert token_files.with_start(token_files.read_sums(spark, none)).count() == 0


# -- 1: token counts -------------------------------------------------------------

BYTES = public_tokenizers.path(token_counts.BYTE_BPE)


def brute(spans, secs, rule):
    out, outside = [0.0] * len(secs), 0.0
    for st, en in spans:
        shared = [max(0, min(en, b) - max(st, a)) for a, b in secs]
        if rule == "split":
            for i, x in enumerate(shared):
                out[i] += x / (en - st)
            outside += 1 - sum(shared) / (en - st)
            continue
        hits = {"start": [i for i, (a, b) in enumerate(secs) if a <= st < b], "end": [i for i, (a, b) in enumerate(secs) if a < en <= b],
                "largest": [shared.index(max(shared))] if secs and max(shared) else []}[rule]
        if hits:
            out[hits[0]] += 1
        else:
            outside += 1
    return out, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_matches_brute_force(rule):
    rnd = random.Random(4)
    enc = token_counts.SpanEncoder(BYTES)
    parts = ["the ", "é", "😀", "\n", "\n\n", " ", "abc", "ö", "中文", "123", "'s", "  \n ", "x"]
    for _ in range(400):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        start, stop = enc.spans(s.encode())
        assert (start < stop).all() if len(s) else not len(start)
        cuts = sorted(rnd.sample(range(len(s) + 1), min(len(s) + 1, rnd.randint(0, 6))))
        secs = [(a, b) for a, b in zip(cuts, cuts[1:]) if rnd.random() < 0.8]
        a, b = (np.array([x[i] for x in secs], np.int64) for i in (0, 1))
        counts, outside, _ = token_counts.attribute(start, stop, a, b, rule)
        want, rest = brute(list(zip(start.tolist(), stop.tolist())), secs, rule)
        assert np.allclose(counts, want) and abs(outside - rest) < 1e-9
        assert abs(sum(counts) + outside - len(start)) < 1e-9


def test_spans_equal_the_library():
    enc = token_counts.SpanEncoder(BYTES)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    for s in random_texts(300, 9):
        want = lib.encode(s, add_special_tokens=False)
        assert enc.ids(s).tolist() == want.ids


def test_token_counts_by_line_and_field(spark, awkward, empty):
    enc = token_counts.SpanEncoder(BYTES)
    rows = awkward.collect()
    got = token_counts.count_tokens(awkward, BYTES).collect()
    assert sum(r.n_tokens for r in got) == sum(len(enc.ids(r.text or "")) for r in rows)
    assert sum(r.id == 0 for r in got) == 1 and [r.n_tokens for r in got if r.id == 0] == [0]
    assert len([r for r in got if r.id == 11]) == 5
    text, sections = token_counts.field_text(["id", "text"], "\n\n")
    fields = token_counts.count_tokens(awkward, BYTES, text=text, sections=sections, rule="split").collect()
    assert {r.section for r in fields} <= {0, 1, -1}
    want = sum(len(enc.ids(f"{r.id or ''}\n\n{r.text or ''}")) for r in rows)
    assert abs(sum(r.n_tokens for r in fields) - want) < 1e-6
    assert token_counts.count_tokens(empty, BYTES).count() == 0
    none = token_counts.count_tokens(awkward.limit(5), BYTES, sections=F.lit(None).cast("array<struct<section:bigint,start:bigint,stop:bigint>>"))
    assert {r.section for r in none.collect()} <= {-1}


def test_each_distinct_run_of_a_batch_is_looked_up_once(library):
    class Counting(dict):
        looked_up = 0

        def __getitem__(self, key):
            Counting.looked_up += 1
            return super().__getitem__(key)

    enc = token_files.LibraryEncoder(PATH)
    enc.runs.young, enc.words.young = Counting(), Counting()
    texts = ["the quick  brown\nfox, " * 500] * 3 + [""]
    assert [ids_of(x) for x in enc.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert Counting.looked_up <= 10


def test_columns_and_portions_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(token_files, "RUNS_AT_ONCE", 5)
    texts = [*random_texts(300, 7), *[t or "" for t in TEXTS], "\n \n"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    column = pa.array([t.encode() for t in ["x y", *texts, "z"]], pa.binary()).slice(1, len(texts))
    assert [ids_of(x) for x in token_files.LibraryEncoder(PATH).encode(column)] == want
    assert token_files.LibraryEncoder(PATH).encode([]) == []
