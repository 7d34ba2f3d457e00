"""Operator 8, licence scan: Dice coefficient of word bigrams against templates.

A text is scanned in units: each line, each block (run of lines that are not blank, if it has
several), the whole document (if it has several blocks), and *windows*: for each template the run of words, over
lines and blank lines, with the greatest dice, then those on both sides of it, as long as they reach ``least`` (of windows that share most of their words, the one with the greatest dice).  All but
lines are taken without copyright lines, which name owners and years.  Units and templates are
normalised alike: words are runs of letters and digits in lower case, British and
American spellings of "licence" are one word, and all else separates.  With bags of word bigrams A and B,

    dice = 2 |A n B| / (|A| + |B|)

and a unit has a template's licence if dice >= ``least``.  Then, with m bigrams in the template,

* *size bound*: m * least / (2 - least) <= |A| <= m * (2 - least) / least, and
* *share bound*: at least |A| * least / (2 - least) of the unit's bigrams occur in the template.

Texts without a dense run of the templates' bigrams are passed over by array operations on
hashes, then units by the share bound over all templates together; the size bound picks
the templates, and the dice itself is computed on the words.  Time and memory go linearly with the length of a text.  Of several templates the greatest dice counts, of equals the first name.
A window counts if no other unit with its licence and as great a dice overlaps it.

Templates are the usual notices and the whole texts (of AGPL-3.0 and the CC-BY licences notices only).  Licences that differ in few words have *marks* (name, kind, version,
the third BSD clause): a unit takes a licence only if the marks of its first ``MARKED`` words are the template's.
A notice without a version number agrees with each version.

Documents are read once and never shuffled; the templates are a fixed list.

Edge cases.  Null and empty texts and units of fewer than two words have no licence.  Repeated
rows are scanned one by one.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import hashing
from cairn.llm.common import ship, table, text_bytes
from cairn.llm.license_texts import TEXTS


def _gnu(what: str, kind: str, version: str) -> list[str]:
    """The usual notices of a GNU licence: with and without later versions, of two and of three paragraphs."""
    out = []
    for either in (f"either version {version} of the License, or (at your option) any later version", f"version {version} of the License"):
        two = (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General "
               f"Public License as published by the Free Software Foundation, {either}. This {what} is distributed in the hope "
               "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
               f"FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.")
        out += [two, f"{two} You should have received a copy of the GNU {kind}General Public License along with this {what}. "
                     "If not, see <https://www.gnu.org/licenses/>."]
    return out


# Public licence notices, as they are commonly put in files.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("program", "Affero ", "3")],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-1.0": ["This work is licensed under the GNU General Public License, version 1.", *_gnu("program", "", "1")],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        *_gnu("program", "", "2")],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
        *_gnu("program", "", "3")[1:]],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.0": [
        "This work is licensed under the GNU Library General Public License, version 2.", *_gnu("library", "Library ", "2")],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.", *_gnu("library", "Lesser ", "2.1")],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu("library", "Lesser ", "3")],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
for _name, _text in TEXTS.items():
    TEMPLATES[_name].append(_text)

#: Bigrams that tell licences apart, besides version numbers, and the words at the start that they are looked for in.
MARKS = {tuple(x.encode().split()) for x in (
    "lesser general", "library general", "affero general", "attribution noncommercial", "attribution sharealike",
    "attribution noderivatives", "attribution noderivs", "noncommercial sharealike", "noncommercial noderivatives",
    "by nc", "by sa", "by nd", "nc sa", "nc nd", "neither the", "mit license", "apache license", "mozilla public")}
MARKED = 200

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
               for b in range(256))
#: One spelling for each group.
SPELLINGS = {b"licence": b"license", b"licenced": b"licensed", b"licences": b"licenses", b"sublicence": b"sublicense"}


def words_of(raw: bytes) -> list[bytes]:
    return [SPELLINGS.get(w, w) for w in raw.translate(_LOWER).split()]


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    size = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / size if size else 0.0


def units(raw: bytes, matcher: Matcher | None = None) -> list[tuple[str, int, list[bytes]]]:
    """(scope, first line, words) of each unit of a text."""
    return [(scope, rows[0], words) for scope, rows, words in spans(raw, matcher or Matcher(TEMPLATES, 0.85))]


def spans(raw: bytes, matcher: Matcher) -> list[tuple[str, tuple[int, int], list[bytes]]]:
    """(scope, first and last line, words) of each unit."""
    lines = raw.split(b"\n")
    words = [words_of(line) for line in lines]
    out = [("line", (i, i), w) for i, w in enumerate(words) if len(w) > 1]
    blocks: list[list[int]] = []
    for i, w in enumerate(words):
        if not w:
            continue
        if blocks and blocks[-1][-1] == i - 1:
            blocks[-1].append(i)
        else:
            blocks.append([i])
    scopes = [("block", b) for b in blocks if len(b) > 1]
    if len(blocks) > 1:
        scopes.append(("document", [i for b in blocks for i in b]))
    for scope, rows in scopes:
        joined = [w for i in rows if not is_copyright(words[i]) for w in words[i]]
        if len(joined) > 1:
            out.append((scope, (rows[0], rows[-1]), joined))
    place = [i for i, w in enumerate(words) if not is_copyright(w) for _ in w]
    joined = [w for line in words if not is_copyright(line) for w in line]
    for a, b in matcher.windows(joined):
        out.append(("window", (place[a], place[b - 1]), joined[a:b]))
    return out


def marks(words: list[bytes]) -> set:
    """The marks among the first words: bigrams of MARKS, and versions (one or two numbers after "version" or "v")."""
    head = words[:MARKED]
    out = {x for x in zip(head, head[1:]) if x in MARKS}
    for i, w in enumerate(head[:-1]):
        if w in (b"version", b"v") and head[i + 1].isdigit():
            # ".0" is left out: version 2 is version 2.0.
            minor = [x for x in words[i + 2:i + 3] if x.isdigit() and len(x) == 1 and x != b"0"]
            out.add((b"version", head[i + 1], *minor))
    return out


def whole_version(words: list[bytes], end: int) -> int:
    """The end of a window, moved past a version number that it cuts."""
    for i in (end - 1, end - 2):
        if i >= 0 and words[i] in (b"version", b"v"):
            while end < len(words) and end <= i + 2 and words[end].isdigit() and (end == i + 1 or len(words[end]) == 1):
                end += 1
    return end


def agree(own: set, needed: set) -> bool:
    """Whether a unit's marks are a template's; a unit that gives no version number may have any."""
    if not any(x[0] == b"version" for x in own):
        needed = {x for x in needed if x[0] != b"version"}
    return own == needed


def is_copyright(words: list[bytes]) -> bool:
    return bool(words) and words[0] in (b"copyright", b"\xc2\xa9")


class Matcher:
    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.bound = least / (2 - least)
        texts = [(name, words_of(t.encode())) for name in sorted(templates) for t in templates[name]]
        self.bags = [(name, bigrams(w), len(w) - 1, marks(w)) for name, w in texts if len(w) > 1]
        self.known = {pair for _, bag, _, _ in self.bags for pair in bag}
        self.number = {pair: i for i, pair in enumerate(sorted(self.known))}
        self.sizes = np.array([x[2] for x in self.bags])
        #: Row: number of a bigram (the last: of none), column: template.
        self.counts = np.zeros((len(self.number) + 1, len(self.bags)), np.int32)
        for k, (_, bag, _, _) in enumerate(self.bags):
            for pair, c in bag.items():
                self.counts[self.number[pair], k] = c
        #: Fewest bigrams of a unit with a licence.
        self.shortest = max(1, int(np.ceil(self.sizes.min() * self.bound - 1e-9))) if self.bags else 1
        self.vocabulary = {w for pair in self.known for w in pair}

    def match(self, words: list[bytes]) -> tuple[str, float] | None:
        """The unit's licence and dice."""
        n = len(words) - 1
        fitting = [x for x in self.bags if x[2] * self.bound <= n <= x[2] / self.bound]
        if not fitting:
            return None
        bag, own = bigrams(words), marks(words)
        best = None
        for name, other, _, needed in fitting:
            if not agree(own, needed):
                continue
            value = dice(bag, other)
            if value >= self.least and (best is None or value > best[1]):
                best = (name, value)
        return best

    def windows(self, words: list[bytes]) -> list[tuple[int, int]]:
        """First word and end of the windows of a text, sorted."""
        if len(words) < 2 or not self.bags:
            return []
        ids = np.array([self.number.get(x, -1) for x in zip(words, words[1:])])
        total = np.concatenate([[0.0], np.cumsum((ids >= 0) - self.bound)])
        # A bigram is in some run with the share of known bigrams that a unit needs if the sums allow it.
        low, high = np.minimum.accumulate(total)[:-1], np.maximum.accumulate(total[::-1])[::-1][1:]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], high >= low - 1e-9, [0]]).astype(int)))
        out = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.shortest:
                continue
            used, times = np.unique(ids[a:b], return_counts=True)
            there = np.minimum(times[:, None], self.counts[used]).sum(axis=0)
            order = np.argsort(ids[a:b], kind="stable")
            for k in np.flatnonzero(there >= self.sizes * self.bound - 1e-9).tolist():
                out += [(-value, a + f, a + t + 1) for f, t, value in self.best_windows(ids[a:b], order, k)]
        # Templates that are much alike find the same place: there the greatest dice counts.  Windows that share more
        # than half of the longer one hold each other's middle, so only those with their middle inside are compared.
        kept: list[tuple[int, int, int]] = []
        for _, a, b in sorted(set(out), key=lambda x: (x[0], x[1] - x[2], x[1])):
            near = kept[bisect_left(kept, (a + a,)):bisect_left(kept, (b + b + 1,))]
            if all(2 * (min(b, y) - max(a, x)) <= max(b - a, y - x) for _, x, y in near):
                insort(kept, (a + b, a, b))
        return sorted((a, whole_version(words, b)) for _, a, b in kept)

    def best_windows(self, ids: np.ndarray, order: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(first, end, dice) of the run of bigrams with the greatest dice with template k, then of those on both
        sides of it, and so on, as long as they reach ``least``; of equal ones the first start, then the shortest.

        ``order`` sorts ``ids`` stably.  Bounds for all starts come from array operations, the run itself is searched
        from starts in the order of their bounds only, at most ``m / bound`` bigrams far: time goes linearly with the
        text, however many runs it holds."""
        n, m = len(ids), int(self.sizes[k])
        fewest, longest = m * self.bound - 1e-9, min(n, int(m / self.bound + 1e-9))
        count = self.counts[ids, k]
        match = count > 0
        sums = np.concatenate([[0], np.cumsum(match)])
        if (sums[np.minimum(np.arange(n) + longest, n)] - sums[:-1]).max() < fewest:
            return []
        # The place from which on a window's start leaves this occurrence within the template's count.
        grouped = ids[order]
        back = np.arange(n) - count[order]
        same = (back >= 0) & (grouped[np.maximum(back, 0)] == grouped)
        free = np.empty(n, np.int64)
        free[order] = np.where(same, order[np.maximum(back, 0)] + 1, 0)
        at = np.flatnonzero(match)
        since = free[at]
        # Greatest dice of a window from each start: what the longest window of each class of lengths holds, over the
        # shortest size that it can have then.
        bound, below = np.zeros(n), int(np.ceil(fewest)) - 1
        for length in self.lengths(m):
            first = np.maximum(since, at - length + 1)
            held = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1))[:n]
            bound = np.maximum(bound, np.where(held >= fewest, 2 * held / (np.maximum(held, below + 1) + m), 0))
            below = length
        starts = np.flatnonzero(match & (bound >= self.least - 1e-9))
        queue = iter(starts[np.lexsort((starts, -bound[starts]))].tolist())
        gone = np.zeros(n, bool)
        seen: list[tuple[float, int, int, int]] = []
        firsts, out = [], []
        ahead = next(queue, None)
        while ahead is not None or seen:
            if ahead is not None and (not seen or bound[ahead] >= -seen[0][0]):
                a, limit, ahead = ahead, n + 1, next(queue, None)
            else:
                value, a, end, limit = heappop(seen)
            if gone[a]:
                continue
            here = bisect_left(firsts, a)
            here = firsts[here] if here < len(firsts) else n
            if limit <= n and (limit == here or end <= here):
                out.append((a, end, -value))
                gone[a:end] = True
                insort(firsts, a)
                continue
            stop = min(a + longest, here)
            held = np.cumsum(match[a:stop] & (free[a:stop] <= a))
            values = 2 * held / (np.arange(1, len(held) + 1) + m)
            best = int(values.argmax())
            if values[best] >= self.least:
                heappush(seen, (-float(values[best]), a, a + best + 1, here))
        return out

    def lengths(self, m: int) -> list[int]:
        """Classes of window lengths for a template of m bigrams: their greatest lengths, m among them."""
        ends = {int(round(m * self.bound ** (1 - i / 4))) for i in range(1, 5)} | {int(round(m / self.bound ** (i / 4))) for i in range(1, 4)}
        return sorted(x for x in ends if x > 0) + [int(m / self.bound + 1e-9) + 1]

    def known_pairs(self) -> np.ndarray:
        """Sorted hashes of all templates' bigrams, with each spelling of a word."""
        other = {}
        for a, b in SPELLINGS.items():
            other.setdefault(b, [b]).append(a)
        pairs = sorted({x + b" " + y for a, b in self.known for x in other.get(a, [a]) for y in other.get(b, [b])})
        return np.unique(_pair_hashes(pa.array(pairs, pa.binary())))


def _pair_hashes(texts: pa.Array) -> np.ndarray:
    words = hashing.Words(plain_classes())
    return np.concatenate([pair_hash(words.tokens(data, offsets)[0])[::2] for _, _, data, offsets in hashing.runs(texts)])


def plain_classes() -> np.ndarray:
    """Words are runs of 0-9, A-Z, a-z and non-ASCII bytes; all else separates."""
    out = hashing.word_mark_classes()
    out[out == 2] = 0
    return out


def pair_hash(h: np.ndarray) -> np.ndarray:
    return hashing.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def candidates(words: hashing.Words, known: np.ndarray, data: np.ndarray, offsets: np.ndarray, shortest: int,
               bound: float) -> np.ndarray:
    """Whether each text can have a unit with a licence: a run of ``shortest`` or more bigrams has the share ``bound`` of
    known ones only if one of less than twice that length has.  A run that a copyright line parts may have none,
    so texts with such a word need one known bigram only."""
    h, first = words.tokens(data, offsets)
    keep = np.zeros(len(offsets) - 1, bool)
    if len(h) < 2:
        return keep
    pairs = pair_hash(h)
    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    found = np.concatenate([[0], np.cumsum(known[at] == pairs)])
    dense = np.zeros(len(pairs), bool)
    for n in range(shortest, 2 * shortest):
        if n <= len(pairs):
            dense[:len(pairs) - n + 1] |= found[n:] - found[:-n] >= n * bound - 1e-9
    some = np.concatenate([[0], np.cumsum(dense)])
    begin, end = first[:-1], np.maximum(first[1:] - 1, first[:-1])
    inside = lambda x: x[np.minimum(end, len(pairs))] > x[np.minimum(begin, len(pairs))]
    keep = inside(some)
    for i in np.flatnonzero(inside(found) & ~keep).tolist():
        text = data[offsets[i]:offsets[i + 1]].tobytes()
        keep[i] = b"\xc2\xa9" in text or b"copyright" in text.lower()
    return keep


class Scanner:
    def __init__(self, matcher: Matcher):
        self.matcher = matcher

    def scan(self, raw: bytes) -> list[tuple[str, int, str, float]]:
        """(scope, first line, licence, dice) of each unit with a licence."""
        m = self.matcher
        out = []
        # By licence, the greatest dice of the units that hold each line.
        where = defaultdict(lambda: np.zeros(raw.count(b"\n") + 1))
        for scope, (line, last), words in spans(raw, m):
            known = sum(p in m.known for p in zip(words, words[1:]))
            if known >= (len(words) - 1) * m.bound - 1e-9:
                if found := m.match(words):
                    place = where[found[0]][line:last + 1]
                    if scope == "window" and place.max() >= found[1]:
                        continue
                    out.append((scope, line, *found))
                    np.maximum(place, found[1], out=place)
        return out


SCHEMA = ("id bigint, licenses array<string>, best_license string, best_dice double, best_scope string, "
          "best_line bigint, n_units bigint")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.85,
                  templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: its licences (sorted), the unit with the greatest dice (of
    equals the first line, then the smallest scope), and the number of units with a licence."""
    ship(docs.sparkSession)
    chosen = TEMPLATES if templates is None else templates
    order = ("line", "block", "window", "document")

    def rows(batches):
        scanner = Scanner(Matcher(chosen, least))
        m = scanner.matcher
        known = m.known_pairs()
        words = hashing.Words(plain_classes())
        for batch in batches:
            content = batch.column("content")
            found: list[list] = [[] for _ in range(len(content))]
            for row, _, data, offsets in hashing.runs(content):
                for i in np.flatnonzero(candidates(words, known, data, offsets, m.shortest, m.bound)).tolist():
                    found[row + i] = scanner.scan(content[row + i].as_py())
            best = [min(f, key=lambda x: (-x[3], x[1], order.index(x[0]))) if f else None for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([sorted({x[2] for x in f}) for f in found], pa.list_(pa.string())),
                pa.array([b and b[2] for b in best], pa.string()), pa.array([b and b[3] for b in best], pa.float64()),
                pa.array([b and b[0] for b in best], pa.string()), pa.array([b and b[1] for b in best], pa.int64()),
                pa.array([len(f) for f in found], pa.int64())],
                names=["id", "licenses", "best_license", "best_dice", "best_scope", "best_line", "n_units"])

    return (docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("content"))
                .mapInArrow(rows, SCHEMA))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.concat_ws(",", "licenses").alias("licenses"), "best_license",
                        F.round("best_dice", 6).alias("best_dice"), "best_scope", "best_line", "n_units")
