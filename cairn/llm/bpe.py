"""Operator 5, BPE encoding and decoding as streaming transducers.

**Encoder.**  A merge list turns a piece of symbols into tokens by applying, again and again,
the pair of least rank (the leftmost of equals).  Whether a boundary between
two symbols survives can depend on what follows only through a chain of
overlapping merges of falling rank: a merge ``(u, v)`` fails because an earlier
one took ``v``, or an end part that ``v`` was to be built from, together with what
follows it; and so on.  ``Merges.lookahead`` is the longest such chain in
symbols.  It is computed once from the merge list, in rank order:

    reach(u, v) = len(v) + max(0, reach(s, w))  over the merges (s, w) of lesser
                  rank whose left part s ends v (s = v, right(v), right(right(v)), ...)

So a boundary that lies at least ``lookahead`` symbols before the end of what was read is final,
whatever follows.  ``PieceEncoder`` takes symbols in any portions, keeps those after the last final boundary, and
emits the tokens before it: its buffer never exceeds ``lookahead + chunk + longest token``
symbols, however long the piece.  The last symbol of a piece differs
(it carries the end-of-word mark), so one symbol is held back until the next arrives.

**Decoder.**  A state machine from token to text: a token's bytes are fed to
an incremental UTF-8 decoder, which holds back the bytes of an unfinished
character and replaces ill-formed sequences by U+FFFD.

The file's normaliser and its pattern for pieces are the library's own
(``tokenizers``), applied to runs without blanks and line feeds: neither the
normaliser nor the pattern looks across them.  Pieces that occur again are taken from a bounded cache.

Edge cases.  Null and empty texts have no tokens and decode to the empty
text.  Texts of any length work, also one piece of a million symbols.  Repeated rows are done
one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm.common import ship, table, text_bytes

WORD_BPE = "word_bpe_49k.json"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: printable Latin-1 bytes stand for themselves, the others take the
    characters from U+0100 on, in byte order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Merges:
    """A merge list over symbols: ranks, and the lookahead that suffices."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str = "</w>"):
        self.suffix = suffix
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        if len(self.parts) != len(merges):
            raise ValueError("two merges make the same token; the lookahead rule needs one each")
        self.longest = max((self.length(t) for t in self.parts), default=1)
        self.lookahead = self._lookahead(merges)

    def length(self, token: str) -> int:
        """Symbols of a token (the end mark is part of the last symbol)."""
        n = len(token)
        return n - len(self.suffix) if n > len(self.suffix) and token.endswith(self.suffix) else n

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        by_left: dict[str, int] = {}
        most = 0
        for u, v in merges:
            reach, s = 0, v
            while True:
                reach = max(reach, by_left.get(s, 0))
                if s not in self.parts:
                    break
                s = self.parts[s][1]
            reach += self.length(v)
            by_left[u] = max(by_left.get(u, 0), reach)
            most = max(most, reach)
        return most

    def apply(self, symbols: list[str]) -> list[str]:
        """Merge by rank, leftmost first."""
        if len(symbols) > 24:
            return self._apply_long(symbols)
        rank, none = self.ranks.get, 1 << 60
        word = symbols
        order = [rank(p, none) for p in zip(word, word[1:])]
        while order and (least := min(order)) != none:
            i = order.index(least)
            word[i] = token = word[i] + word[i + 1]
            del word[i + 1], order[i]
            if i:
                order[i - 1] = rank((word[i - 1], token), none)
            if i < len(order):
                order[i] = rank((token, word[i + 1]), none)
        return word

    def _apply_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs and a linked list: n log n."""
        ranks = self.ranks
        word: list[str | None] = list(symbols)
        n = len(word)
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = [(r, i, p[0], p[1]) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if word[i] != a or j < 0 or word[j] != b:
                continue
            word[i], word[j] = a + b, None
            k = after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (r := ranks.get((a + b, word[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, word[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((word[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, word[h], a + b))
        return [w for w in word if w is not None]


class PieceEncoder:
    """Streaming transducer for one piece: symbols in, final tokens out."""

    def __init__(self, merges: Merges, chunk: int = 1024):
        self.merges, self.chunk = merges, chunk
        self.buffer: list[str] = []
        self.most = 0

    def feed(self, symbols: str):
        """Take symbols (without the end mark); yield the tokens that are final."""
        room = self.merges.lookahead + self.merges.longest + self.chunk
        at = 0
        while at < len(symbols):
            take = room - len(self.buffer)
            self.buffer += symbols[at:at + take]
            at += take
            self.most = max(self.most, len(self.buffer))
            if len(self.buffer) >= room:
                # The last symbol may still get the end mark: it counts as unread.
                yield from self._final(len(self.buffer) - 1)

    def _final(self, read: int):
        end = 0
        for token in self.merges.apply(self.buffer[:read]):
            n = len(token)
            if end + n > read - self.merges.lookahead:
                break
            end += n
            yield token
        self.buffer = self.buffer[end:]

    def finish(self):
        """The piece ends: yield the tokens that are left."""
        if self.buffer:
            rest, self.buffer = self.buffer, []
            rest[-1] += self.merges.suffix
            yield from self.merges.apply(rest)


class TwoAges(dict):
    """A cache bounded by ``cap`` entries: when the younger half is full it becomes
    the older half; an older entry that is used again moves to the younger."""

    def __init__(self, make, cap: int):
        super().__init__()
        self.make, self.half, self.old = make, cap // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:  # longer ones hardly come again
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """Encode and decode with one of the public byte-level BPE files with word ends."""

    def __init__(self, path: str, cache: int = 800_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = Merges([tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.added_pattern = re.compile("|".join(map(re.escape, self.added)))
        text_of = {i: t for t, i in {**self.vocab, **self.added}.items()}
        size = max(text_of) + 1
        self.strings = [text_of.get(i, "").encode() for i in range(size)]
        self.symbol_of = byte_symbols()
        byte_of = {c: b for b, c in self.symbol_of.items()}
        self.restored = [self._restore(text_of.get(i, ""), byte_of) for i in range(size)]
        self.chunks = TwoAges(self._chunk, cache)
        self.pieces = TwoAges(self._piece, cache // 2)

    def _restore(self, token: str, byte_of: dict[str, int]) -> bytes:
        if token in self.added:
            return token.encode()
        end = bool(self.merges.suffix) and token.endswith(self.merges.suffix)
        plain = token[:-len(self.merges.suffix)] if end else token
        return bytes(byte_of[c] for c in plain) + (b" " if end else b"")

    def _piece(self, symbols: str) -> bytes:
        vocab = self.vocab
        if len(symbols) <= self.merges.lookahead:  # no boundary is final before the piece ends
            word = list(symbols)
            word[-1] += self.merges.suffix
            return array("I", [vocab[t] for t in self.merges.apply(word)]).tobytes()
        enc = PieceEncoder(self.merges)
        return array("I", [vocab[t] for part in (enc.feed(symbols), enc.finish()) for t in part]).tobytes()

    def _symbols(self, word: str) -> str:
        return word if word.isascii() else "".join([self.symbol_of[b] for b in word.encode()])

    def _plain(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[s] for s, _ in self.split(self.normalize(text))])

    def _chunk(self, text: str) -> bytes:
        """Ids of a run without blanks and line feeds; added tokens are found first, in the raw text.

        Latin-1 letters, perhaps with one mark at the end, are one piece and
        that mark: the normaliser only puts them into lower case."""
        word = text[:-1] if text[-1] in ".,;:!?" else text
        if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            ids = self.pieces[self._symbols(word.lower())]
            return ids if word is text else ids + self.pieces[text[-1]]
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += [self._plain(text[at:m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.replace("\n", " ").split(" ") if c])


class Decoder:
    """Token to text, one token at a time.

    Each token's bytes go through an incremental UTF-8 state machine, so what
    ``feed`` returns is final and an unfinished character waits for its other bytes.
    ``restore=False`` gives what the library's ``decode`` gives for a file that names
    no decoder: the tokens' own strings with blanks between them.
    ``restore=True`` gives the bytes that the symbols stand for, with a blank
    for the end-of-word mark."""

    def __init__(self, codec: "WordBpe", restore: bool = False):
        self.bytes_of = codec.restored if restore else codec.strings
        self.glue = b"" if restore else b" "
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids) -> str:
        if not len(ids):
            return ""
        table_ = self.bytes_of
        joined = self.glue.join([table_[i] for i in ids])
        text = self.state.decode(joined if self.first else self.glue + joined)
        self.first = False
        return text

    def finish(self) -> str:
        return self.state.decode(b"", True)


_CODECS: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """One per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = WordBpe(path)
    return _CODECS[path]


TOKEN_SCHEMA = "id bigint, n_tokens bigint, ids binary"
DIGEST_SCHEMA = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids`` per row (ids as little-endian unsigned 32-bit integers)."""
    ship(docs.sparkSession)

    def rows(batches):
        bpe = codec(path)
        for batch in batches:
            ids = [bpe.encode(t.as_py().decode()) for t in batch.column("content")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "n_tokens", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(rows, TOKEN_SCHEMA)


def decode_documents(tokens: DataFrame, path: str, restore: bool = False) -> DataFrame:
    """``id, text`` per row of ``encode_documents``."""
    ship(tokens.sparkSession)

    def rows(batches):
        bpe = codec(path)
        for batch in batches:
            out = ["".join(decoded(bpe, x.as_py(), restore)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    return tokens.mapInArrow(rows, "id bigint, text string")


def decoded(bpe: WordBpe, ids: bytes, restore: bool = False, step: int = 8192):
    """The text of ids, in portions."""
    decoder, numbers = Decoder(bpe, restore), array("I")
    numbers.frombytes(ids)
    for at in range(0, len(numbers), step):
        yield decoder.feed(numbers[at:at + step])
    yield decoder.finish()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass; digests of the ids and of the decoded text."""
    ship(docs.sparkSession)

    def rows(batches):
        bpe = codec(path)
        for batch in batches:
            counts, id_sums, text_sums = [], [], []
            for t in batch.column("content"):
                ids = bpe.encode(t.as_py().decode())
                text_sum = hashlib.sha256()
                for part in decoded(bpe, ids):
                    text_sum.update(part.encode())
                counts.append(len(ids) // 4)
                id_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(text_sum.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()),
                 pa.array(text_sums, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(rows, DIGEST_SCHEMA)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("content"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    return round_trip(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")
