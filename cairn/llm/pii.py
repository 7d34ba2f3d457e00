"""Operator 13, personal data: patterns, checksums and context words.

Patterns propose spans; validators (Luhn, mod-97, check letters, number ranges)
confirm or refuse them; words near a span raise or lower its score.

* The four *base* kinds (email, ip, card, phone) are leftmost, non-overlapping matches per
  kind that pass their validator; a match that fails is dropped and its text isn't tried
  again.  Base spans stay whatever their score.
* The *added* kinds (``ADDED``) are kept at a score of ``threshold`` or more and where they overlap no
  base span; of two that overlap the greater score stays, then the earlier one.
* A score is the rule's own, plus ``CONTEXT_BONUS`` if one of the rule's context words is within
  ``CONTEXT_CHARS`` code points before the span or half as many after it, less ``CONTEXT_MALUS``
  if a word is there that names another kind of number (order, invoice, version ...).

Every pattern is anchored at a character that must be there (``@``, ``+``, the start of a run of
digits, two capitals with two digits), found by a plain search, so the time is linear in the
text, also for megabytes of digits or of letters without a blank.

Scale.  One pass of ``mapInArrow`` over the documents, no shuffle.  A task holds one Arrow batch and the
spans of its rows; a document's spans travel as one array, which its own text bounds.

Edge cases.  Null and empty text has no spans.  Repeated rows and ids give one row each.
Offsets are code points of the whole text, end exclusive.  An empty table gives an empty result.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import ship, table, text_or_empty

#: The contract's kinds, in the order that breaks ties of spans with one start.
BASE = ("email", "ip", "card", "phone")
#: The kinds that validators and context add.
ADDED = ("iban", "nir", "dni", "steuer_id", "ssn", "tel")
KINDS = BASE + ADDED

CONTEXT_CHARS = 48
CONTEXT_BONUS, CONTEXT_MALUS = 0.4, 0.3
THRESHOLD = 0.5

# Lengths of account numbers (IBAN) by country.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
               "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24}
# Check letters of Spanish identity numbers, by the number modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

#: A rule's own score, and the words that make it likelier.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "nir": 0.6, "dni": 0.5, "steuer_id": 0.3, "ssn": 0.3, "tel": 0.2}
CONTEXT = {
    "email": {"email", "mail", "contact", "correo", "courriel", "kontakt"},
    "ip": {"ip", "address", "host", "server", "adresse", "dirección"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "carte", "karte", "tarjeta"},
    "phone": {"phone", "call", "tel", "mobile", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "nir": {"nir", "sécurité", "sociale", "insee"},
    "dni": {"dni", "nif", "identidad"},
    "steuer_id": {"steuer", "steueridentifikationsnummer", "steuernummer", "idnr"},
    "ssn": {"ssn", "social", "security"},
    "tel": {"phone", "call", "tel", "telephone", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"},
}
NOT_PERSONAL = {"order", "invoice", "version", "isbn", "issn", "sku", "ticket", "build", "bestellung", "commande", "pedido"}

_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN_BODY = {n: re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTH.values())}
_NIR = re.compile(r"[12](?: ?[0-9]){14}(?! ?[0-9])")
_DNI = re.compile(r"[0-9]{8}[ -]?[A-Z](?![A-Za-z0-9])")
_STEUER = re.compile(r"[1-9][0-9](?: ?[0-9]{3}){3}(?! ?[0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?:[0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number (no blanks) leaves 1: country and check digits go last, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def nir(digits: str) -> bool:
    """French social security number: the last two digits are 97 less the rest modulo 97."""
    return int(digits[13:]) == 97 - int(digits[:13]) % 97


def mod11_10(digits: str) -> bool:
    """Check digit of ISO 7064 MOD 11,10 (German tax numbers)."""
    product = 10
    for d in digits[:-1]:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def octet(part: str) -> bool:
    """At most 255, whatever its zeros and its length."""
    bare = part.lstrip("0")
    return len(bare) < 3 or len(bare) == 3 and bare <= "255"


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at) if at > end and text[at - 1] in _LOCAL else None
        if m:
            start = at - 1
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str, runs: list[int]) -> Iterator[Span]:
    end = 0
    for start in runs:
        if start >= end and (m := _IP.match(text, start)):
            end = m.end()
            if all(map(octet, m.group().split("."))):
                yield start, end


def cards(text: str, runs: list[int]) -> Iterator[Span]:
    end = 0
    for start in runs:
        if start >= end and (m := _CARD.match(text, start)):
            end = m.end()
            # At most one mark between digits: longer than 37 holds more than 19 digits.
            if end - start <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    yield start, end


def phones(text: str) -> Iterator[Span]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield at, m.end()
        at = text.find("+", m.end() if m else at + 1)


def ibans(text: str) -> Iterator[Span]:
    for head in _IBAN_HEAD.finditer(text):
        start = head.start()
        size = IBAN_LENGTH.get(text[start:start + 2])
        if size and not (start and text[start - 1].isalnum()):
            m = _IBAN_BODY[size].match(text, start)
            if m and mod97(m.group().replace(" ", "")):
                yield start, m.end()


def numbers(text: str, runs: list[int]) -> Iterator[tuple[str, int, int]]:
    """Added kinds that start at a run of digits and pass their check."""
    for start in runs:
        before = text[start - 1] if start else " "
        if before.isalnum() or before in "+-.":
            continue
        if (m := _NIR.match(text, start)) and nir(m.group().replace(" ", "")):
            yield "nir", start, m.end()
        if (m := _DNI.match(text, start)) and DNI_LETTERS[int(text[start:start + 8]) % 23] == text[m.end() - 1]:
            yield "dni", start, m.end()
        if (m := _STEUER.match(text, start)) and mod11_10(m.group().replace(" ", "")):
            yield "steuer_id", start, m.end()
        if (m := _SSN.match(text, start)):
            area, group, serial = m.group().split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield "ssn", start, m.end()
        if (m := _TEL.match(text, start)):
            bracket = ")" in m.group()
            if bracket == (before == "("):
                yield "tel", start - bracket, m.end()


def score(kind: str, text: str, start: int, end: int) -> float:
    """The rule's score, moved by the words around the span; a word that the window cuts counts as it stands."""
    near = _WORD.findall(text[max(0, start - CONTEXT_CHARS):start].lower() + " " + text[end:end + CONTEXT_CHARS // 2].lower())
    out = SCORES[kind]
    if not CONTEXT[kind].isdisjoint(near):
        out += CONTEXT_BONUS
    if not NOT_PERSONAL.isdisjoint(near):
        out -= CONTEXT_MALUS
    return min(1.0, max(0.0, round(out, 4)))


def find(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text by start, then kind."""
    runs = [m.start() for m in _DIGITS.finditer(text)]
    base = [("email", *s) for s in emails(text)] if "@" in text else []
    if runs:
        base += [("ip", *s) for s in ips(text, runs)]
        base += [("card", *s) for s in cards(text, runs)]
        if "+" in text:
            base += [("phone", *s) for s in phones(text)]
    out = [(k, s, e, score(k, text, s, e)) for k, s, e in base]
    if runs:
        more = [("iban", *s) for s in ibans(text)] + list(numbers(text, runs))
        scored = sorted(((k, s, e, p) for k, s, e in more if (p := score(k, text, s, e)) >= threshold),
                        key=lambda x: (-x[3], x[1], KINDS.index(x[0])))
        out += unclashing(scored, [(s, e) for _, s, e in base])
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def unclashing(ranked: list[tuple], taken: list[Span]) -> list[tuple]:
    """The spans of ``ranked``, best first, that overlap neither ``taken`` nor a better one.
    Places are looked up by blocks of code points, so each span meets only those near it."""
    if not ranked:
        return []
    block = 64
    places: dict[int, list[Span]] = {}

    def put(s, e):
        for b in range(s // block, (e - 1) // block + 1):
            places.setdefault(b, []).append((s, e))

    for s, e in taken:
        put(s, e)
    out = []
    for x in ranked:
        s, e = x[1], x[2]
        if not any(a < e and s < z for b in range(s // block, (e - 1) // block + 1) for a, z in places.get(b, ())):
            put(s, e)
            out.append(x)
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def _scan(batches, threshold: float):
    for batch in batches:
        rows = [[{"kind": k, "start": s, "end": e, "score": p, "base": k in BASE} for k, s, e, p in find(t, threshold)] if t else []
                for t in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, _SPANS)], names=["id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, spans) per row of ``docs``; spans are structs (kind, start, end, score, base) by start, then kind."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("content"))
    return rows.mapInArrow(partial(_scan, threshold=threshold),
                           "id bigint, spans array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, text) with every span replaced by its kind in square brackets; overlapping spans become one, named by the first."""
    ship(docs.sparkSession)

    def masked(text: str) -> str:
        parts, done = [], 0
        for kind, s, e, _ in find(text, threshold):
            if s >= done:
                parts += [text[done:s], f"[{kind}]"]
            done = max(done, e)
        return "".join([*parts, text[done:]])

    def run(batches):
        for batch in batches:
            texts = [masked(t) if t else t for t in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("content")).mapInArrow(run, "id bigint, text string")


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the base spans, and all spans."""
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *map(count, BASE),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
