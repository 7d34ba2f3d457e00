"""Operator 12, conversation structure repair by a Viterbi search whose survivors coalesce.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  The cheapest edits that
make it so are found row by row: keep (0), re-role to user or assistant (2), delete (3, required for blank and
duplicate rows), insert an empty user or assistant turn anywhere (2); an undeleted truncated row
costs 1 more.  Of equally cheap repairs the one whose edit initials (D, I, K, R) are
ASCII-least is taken.

* Four states (nothing yet, after a system, user or assistant turn) have one survivor each: its cost, its *rank* among
  the survivors' edit strings, and its leaf in a tree of backpointers.  Survivors are compared at row
  edits (insertions go before them), so none of their strings is a prefix of another, and the order of two complete
  unresolved suffixes is the order of (rank of the parent, letters added): ties are
  decided by whole strings without walking back.
* A survivor that another one can follow at less cost whatever comes is dropped (``prune``).
* Tree nodes count their references.  A node that no survivor descends from is freed; when the root has one
  child left, all survivors share it, its edits are final, and they are emitted.  So the tree
  holds the unresolved suffix alone.
* Costs are held relative to the least one.  What a step does depends on the relative costs, the ranks and the kind
  of row alone, so steps are remembered (``step`` is cached) and a row is a look-up.

Scale.  Rows travel without their text (a 128-bit digest in its place) while faults and edits are
found; equal rows of one turn are one row with a count, and the first turn of each (conversation, role,
text) comes from a partial aggregation, so a hot conversation or a common text is added up before it is
shuffled.  A conversation is then read in order by one task as a stream, the texts once more beside the
final edits, since a digest of a whole conversation is sequential.  No conversation is held: a task's memory is the unresolved
suffix (a few small objects a row, without text) and the audit string that the result has.

Edge cases.  Nulls: a null id or turn is one space in the key of ``damage``, a null role or text is
one space; a null id is a conversation of its own, null turns come first.  Rows of one turn go by role, then by
text digest.  Roles of other initials can't be kept.  A conversation without rows has zeros, an empty audit and the
digest of nothing.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import ASCII_SPACE, ship, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States: nothing yet, after system, after user, after assistant; a conversation may end in the first or the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: Where a kept turn of an initial leads.
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Where a turn goes that may be user or assistant as needed, and what it is then.
NEXT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: More insertions than this between two rows come back to a state at a greater cost.
MOST_INSERTS = 2


def row_edits(kind: tuple[str, bool, bool], state: int):
    """(state after, cost, letter) of what may be done with a row; ``kind``: initial, must go, truncated."""
    initial, must_go, truncated = kind
    yield state, DELETE, "D"
    if not must_go:
        extra = TRUNCATED * truncated
        if (initial, state) in KEPT:
            yield KEPT[initial, state], KEEP + extra, "K"
        yield NEXT[state], REROLE + extra, "R"


def inserted(state: int):
    """(state after, cost, letters) of the insertions before a row or at the end."""
    for n in range(MOST_INSERTS + 1):
        yield state, n * INSERT, "I" * n
        state = NEXT[state]


def prune(costs: dict[int, int]) -> set[int]:
    """States whose survivor can't win: after an assistant turn (or two insertions on) every continuation of "nothing yet" is
    open at 3 more (a system turn that is deleted there), every one of "system" at no more."""
    via = min((costs[s] + n * INSERT for s, n in ((ASSISTANT, 0), (USER, 1)) if s in costs), default=None)
    if via is None:
        return set()
    return {s for s, slack in ((NOTHING, DELETE), (SYSTEM, 0)) if s in costs and costs[s] > via + slack}


@lru_cache(maxsize=100_000)
def step(survivors: tuple, kind: tuple[str, bool, bool]) -> tuple[tuple, tuple, int]:
    """One row.  ``survivors``: (state, relative cost, rank) each.

    Gives the survivors after it, for each of them the index of its parent and the letters added, and what the
    least cost grew by."""
    best: dict[int, tuple] = {}
    for i, (state, cost, rank) in enumerate(survivors):
        for at, paid, letters in inserted(state):
            for after, price, letter in row_edits(kind, at):
                found = (cost + paid + price, rank, letters + letter, i)
                if after not in best or found < best[after]:
                    best[after] = found
    for state in prune({s: b[0] for s, b in best.items()}):
        del best[state]
    least = min(b[0] for b in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    ranks = {s: r for r, s in enumerate(order)}
    states = sorted(best)
    return (tuple((s, best[s][0] - least, ranks[s]) for s in states),
            tuple((best[s][3], best[s][2]) for s in states), least)


def last(survivors: tuple) -> tuple[int, str, int]:
    """(index of the winner, insertions at the end, cost over the least) when no row is left."""
    ends = []
    for i, (state, cost, rank) in enumerate(survivors):
        for at, paid, letters in inserted(state):
            if at in ENDS:
                ends.append((cost + paid, rank, letters, i))
    cost, _, letters, i = min(ends)
    return i, letters, cost


class Node:
    """A backpointer: the letters added at a row, and how many refer to it."""

    __slots__ = ("parent", "letters", "row", "refs", "children")

    def __init__(self, parent, letters, row):
        self.parent, self.letters, self.row = parent, letters, row
        self.refs, self.children = 0, []


class Search:
    """The survivors of one conversation.  ``put`` and ``close`` yield (letters, row) that are final, in order."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.survivors, self.leaves = ((NOTHING, 0, 0),), [self.root]
        self.root.refs = 1
        self.cost = 0
        self.held = 1

    def release(self, node: Node) -> None:
        node.refs -= 1
        while not node.refs and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            parent.refs -= 1
            self.held -= 1
            node = parent

    def put(self, kind: tuple[str, bool, bool], row):
        self.survivors, links, grown = step(self.survivors, kind)
        self.cost += grown
        leaves = []
        for parent, letters in links:
            node = Node(self.leaves[parent], letters, row)
            node.refs = 1
            node.parent.refs += 1
            node.parent.children.append(node)
            leaves.append(node)
        self.held += len(leaves)
        old, self.leaves = self.leaves, leaves
        for node in old:
            self.release(node)
        yield from self.settled()

    def settled(self):
        while self.root.refs == 1 and self.root.children:
            self.root = self.root.children[0]
            self.root.parent = None
            self.held -= 1
            yield self.root.letters, self.root.row

    def close(self):
        i, letters, more = last(self.survivors)
        self.cost += more
        winner = self.leaves[i]
        for node in self.leaves:
            if node is not winner:
                self.release(node)
        self.leaves = [winner]
        yield from self.settled()
        if letters:
            yield letters, None


def apply(state: int, letters: str, role: str | None):
    """(edit, role after, state after) of final letters; the last one is the row's own unless ``role`` is None."""
    out = []
    for n, letter in enumerate(letters):
        if letter == "D":
            out.append(("D", role))
        elif letter == "K":
            state = KEPT[role[:1], state]
            out.append(("K", role))
        else:
            state = NEXT[state]
            out.append((letter, NAMES[state]))
    return out, state


# ---------------------------------------------------------------- Spark

def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the stated damage: by crc32 of ``conv_id:turn`` modulo 20, 0 drops the row, 1 empties
    the text, 2 removes its ends of sentences, 3 repeats the row, 4 sets the role to user."""
    space = F.lit(" ")
    ids, turns = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    key = F.concat(F.coalesce(ids.cast("string"), space), F.lit(":"), F.coalesce(turns.cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    marked = rows.select(ids.alias("conv_id"), turns.alias("turn"), role.alias("role"), text.alias("text"), fault.alias("__f"))
    return (marked.where("__f != 0")
            .select("conv_id", "turn", F.when(F.col("__f") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("__f") == 1, "").when(F.col("__f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("__f") == 3, 2).otherwise(1).alias("__n"))
            .select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("__n"))).alias("__x")).drop("__x"))


#: Rows of the streams: the marker of a conversation comes first, its summary last.
_NARROW = "conv_id bigint, kind int, turn bigint, role string, key binary, n bigint, initial string, blank boolean, truncated boolean, first boolean"
_EDITS = "conv_id bigint, kind int, turn bigint, role string, key binary, text string, place bigint, edits string, " \
         "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
MARKER, ROW, EDIT, END = 0, 1, 1, 2
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def narrow_rows(rows: DataFrame) -> DataFrame:
    """Rows without text: equal rows of a turn are one with a count ``n``; ``first`` if the turn is the first of its role and text."""
    ends = F.right(F.rtrim(F.col("text"), F.lit(ASCII_SPACE)), F.lit(1))
    seen = rows.select("conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"),
                       F.left("role", F.lit(1)).alias("initial"), (ends == "").alias("blank"), (~ends.isin(".", "!", "?")).alias("truncated"))
    per = seen.groupBy("conv_id", "turn", "role", "key").agg(
        F.count(F.lit(1)).alias("n"), F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    # The least struct has the null turn first.
    start = per.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min(F.struct("turn")).alias("start"))
    return (per.join(start, per.conv_id.eqNullSafe(start.c) & (per.role == start.r) & (per["key"] == start.k))
            .select("conv_id", F.lit(ROW).alias("kind"), "turn", "role", "key", "n", "initial", "blank", "truncated",
                    F.col("turn").eqNullSafe(F.col("start.turn")).alias("first")))


class Collector:
    """Rows of one schema, in Arrow batches of a bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 2000, size: int = 4 << 20):
        self.schema, self.rows, self.size = schema, rows, size
        self.held, self.bytes = [], 0

    def add(self, row: tuple, size: int = 100):
        self.held.append(row)
        self.bytes += size
        if len(self.held) >= self.rows or self.bytes >= self.size:
            yield from self.flush()

    def flush(self):
        if self.held:
            columns = zip(*self.held)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.held, self.bytes = [], 0


def _rows(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in names))


_EDIT_ARROW = pa.schema([("conv_id", pa.int64()), ("kind", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary()),
                         ("text", pa.string()), ("place", pa.int64()), ("edits", pa.string()), *((x, pa.int64()) for x in COUNTS)])
_NONE = object()


class _Conversation:
    """The stream of one conversation: counts its faults and searches its edits."""

    def __init__(self, conv_id):
        self.id, self.search = conv_id, Search()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.final = self.turn = None
        self.before = _NONE
        self.done = 0

    def row(self, turn, role, key, n, initial, blank, truncated, first):
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first, self.final = turn if self.first is None else self.first, turn
            self.turn = turn
        self.illegal += (n - 1) + (self.before is not _NONE and self.before + initial not in ("su", "ua", "au"))
        self.before = initial
        for copy in range(n):
            again = not blank and not (first and not copy)
            cut = truncated and not blank and not again
            self.blank += blank
            self.duplicate += again
            self.truncated += cut
            yield from self.search.put((initial, blank or again, cut), (turn, role, key))

    def end(self):
        yield from self.search.close()

    def summary(self):
        gaps = self.final - self.first + 1 - self.turns if self.turns else 0
        return (self.id, END, None, None, None, None, None, None, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.search.cost)


def _search(batches):
    """Edits per row, in the rows' order, and a summary per conversation."""
    out, conv = Collector(_EDIT_ARROW), None
    nothing = (None,) * len(COUNTS)

    def emit(edits):
        for letters, row in edits:
            turn, role, key = row or (None, None, None)
            yield from out.add((conv.id, EDIT if row else END, turn, role, key, None, conv.done, letters, *nothing))
            conv.done += 1

    def finish():
        if conv is not None:
            yield from emit(conv.end())
            yield from out.add(conv.summary())

    for conv_id, kind, *row in _rows(batches, ["conv_id", "kind", "turn", "role", "key", "n", "initial", "blank", "truncated", "first"]):
        if conv is None or conv_id != conv.id:
            yield from finish()
            conv = _Conversation(conv_id)
        if kind == ROW:
            yield from emit(conv.row(*row))
    yield from finish()
    yield from out.flush()


def edits(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Final edits of ``rows`` (conv_id, turn, role, text) as rows of letters by (turn, role, key), insertions at the end,
    and a summary row for each id of ``conversations``."""
    ship(rows.sparkSession)
    marks = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().selectExpr(
        "conv_id", f"{MARKER} AS kind", "cast(null AS bigint) AS turn", "'' AS role", "cast(null AS binary) AS key", "0L AS n", "'' AS initial",
        "false AS blank", "false AS truncated", "false AS first")
    stream = marks.unionByName(narrow_rows(rows))
    return (stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key").mapInArrow(_search, _EDITS))


_MESSAGE = "conv_id bigint, edit string, role string, text string, " \
           "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_MESSAGE_ARROW = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
                            *((x, pa.int64()) for x in COUNTS)])


def _messages(batches):
    """Edits and texts in one stream: each row's letters come before its text, once for each of its copies."""
    out = Collector(_MESSAGE_ARROW)
    nothing = (None,) * len(COUNTS)
    # Letters that wait for the copies of their row, as [letters, times].
    current, state, waiting = _NONE, NOTHING, deque()
    for conv_id, kind, _, role, _, text, _, letters, *summary in _rows(batches, _EDIT_ARROW.names):
        if current is _NONE or conv_id != current:
            current, state = conv_id, NOTHING
        if letters is not None and kind == EDIT:
            if waiting and waiting[-1][0] == letters:
                waiting[-1][1] += 1
            else:
                waiting.append([letters, 1])
        elif letters is not None:
            done, state = apply(state, letters, None)
            for edit, name in done:
                yield from out.add((conv_id, edit, name, "", *nothing))
        elif kind == END:
            yield from out.add((conv_id, None, None, None, *summary))
        else:
            done, state = apply(state, waiting[0][0], role)
            waiting[0][1] -= 1
            if not waiting[0][1]:
                waiting.popleft()
            for edit, name in done:
                yield from out.add((conv_id, edit, name, "" if edit == "I" else text, *nothing), 100 + len(text))
    yield from out.flush()


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The edited messages of all conversations, in order within each (one partition holds a conversation): (conv_id, edit, role, text,
    counts); edit is K, R, D or I, and null in the summary row that ends a conversation and has the
    counts.  Messages but those of edit D are the repaired conversation."""
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    found = edits(rows, rows if conversations is None else conversations)
    texts = rows.select("conv_id", F.lit(ROW).alias("kind"), "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"),
                        "text", F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("string").alias("edits"),
                        *(F.lit(None).cast("bigint").alias(x) for x in COUNTS))
    # Letters of a row come in their order before its texts, those at a conversation's end before its summary.
    return (found.unionByName(texts).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", "turn", "role", "key", F.col("edits").isNull(), "place")
            .mapInArrow(_messages, _MESSAGE))


def _digests(batches):
    """One row per conversation from messages in order."""
    schema = pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out = Collector(schema)
    audit, digest, any_ = bytearray(), hashlib.sha256(), False
    for conv_id, edit, role, text, *summary in _rows(batches, _MESSAGE_ARROW.names):
        if edit is None:
            yield from out.add((conv_id, *summary, audit.decode(), digest.hexdigest()), 200 + len(audit))
            audit, digest, any_ = bytearray(), hashlib.sha256(), False
        else:
            audit += edit.encode()
            if edit != "D":
                digest.update(("\n" * any_ + role + ":" + text).encode())
                any_ = True
    yield from out.flush()


def summaries(messages: DataFrame) -> DataFrame:
    """A row per conversation of ``repair``'s result, read where it lies: counts, audit and digest."""
    return messages.mapInArrow(_digests, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                                         "cost bigint, audit string, repaired_sha256 string")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as stated, with its faults, the cheapest edits and the digest of what they give."""
    rows = table(spark, sf_dir, "conversations")
    return summaries(repair(damage(rows), rows))


OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
-- crc32 bit by bit: a byte is xored in, then eight shifts (-1 each).
crc AS (
  SELECT *, xor(4294967295, list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(k, ''),
           lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END)) % 20 AS f
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM crc WHERE f != 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS ini, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS fin,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM placed),
rows_ AS (
  SELECT *, fin = '' AS blank, fin != '' AND again > 1 AS dup, fin != '' AND again = 1 AND fin NOT IN ('.', '!', '?') AS cut,
         fin = '' OR again > 1 AS must, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM counted),
ins(st, n, mid, added) AS (VALUES
  ('', 0, '', ''), ('', 1, 'u', chr(10) || 'user:'), ('', 2, 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 0, 's', ''), ('s', 1, 'u', chr(10) || 'user:'), ('s', 2, 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 0, 'u', ''), ('u', 1, 'a', chr(10) || 'assistant:'), ('u', 2, 'u', chr(10) || 'assistant:' || chr(10) || 'user:'),
  ('a', 0, 'a', ''), ('a', 1, 'u', chr(10) || 'user:'), ('a', 2, 'a', chr(10) || 'user:' || chr(10) || 'assistant:')),
edit(letter) AS (VALUES ('D'), ('K'), ('R')),
v AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS st, 0::BIGINT AS cost, '' AS audit, '' AS made FROM conversations
  UNION ALL
  SELECT conv_id, i, st, best.cost, best.audit, best.made FROM (
    SELECT conv_id, i, st, min({'cost': cost, 'audit': audit, 'made': made}) AS best FROM (
      SELECT v.conv_id, r.i,
             CASE letter WHEN 'D' THEN mid WHEN 'K' THEN ini ELSE CASE mid WHEN 'u' THEN 'a' ELSE 'u' END END AS st,
             v.cost + 2 * n + CASE letter WHEN 'D' THEN 3 WHEN 'K' THEN r.cut::INT ELSE 2 + r.cut::INT END AS cost,
             v.audit || repeat('I', n) || letter AS audit,
             v.made || added || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
               ELSE chr(10) || CASE mid WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text END AS made
      FROM v JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1 JOIN ins ON ins.st = v.st CROSS JOIN edit
      WHERE letter = 'D' OR NOT must AND (letter = 'R' OR ini = 's' AND mid = '' OR ini = 'u' AND mid != 'u' OR ini = 'a' AND mid = 'u'))
    GROUP BY conv_id, i, st)),
stats AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate,
         count_if(cut) AS truncated, count_if(i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
ends AS (
  SELECT v.conv_id, min({'cost': cost + 2 * ins.n, 'audit': audit || repeat('I', ins.n), 'made': made || added}) AS best
  FROM v LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM v.conv_id JOIN ins ON ins.st = v.st
  WHERE v.i = coalesce(s.n, 0) AND mid IN ('', 'a') GROUP BY v.conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       sha256(substr(best.made, 2)) AS repaired_sha256
FROM ends e LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""
