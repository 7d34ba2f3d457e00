"""Operator 12 against all repairs of short conversations, a plain dynamic program on long ones, and edge rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from cairn.llm import conversations as op

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest()


def damaged(rows):
    """conv_id -> rows in order, of (conv_id, turn, role, text) rows."""
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[c] += [(t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: sorted(r, key=order) for c, r in out.items()}


def kinds(rows):
    """(initial, must go, truncated) per row, and the faults."""
    seen, out, faults = set(), [], Counter()
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    return out, faults


def exhaustive(kind):
    """(cost, audit) by trying every choice: up to two insertions before each row and at the end."""
    found = []
    for gaps in itertools.product(range(3), repeat=len(kind) + 1):
        for edits in itertools.product("DKuaR"[:4], repeat=len(kind)):
            cost, audit, roles = 2 * sum(gaps), "", ""
            options = [""]
            for n, e, (initial, must, cut) in zip(gaps, edits, kind):
                audit += "I" * n
                options = [o + "".join(x) for o in options for x in itertools.product("ua", repeat=n)]
                if must and e != "D":
                    break
                cost += 3 if e == "D" else cut + (0 if e == "K" else 2)
                audit += {"D": "D", "K": "K"}.get(e, "R")
                if e != "D":
                    options = [o + ((initial or "?") if e == "K" else e) for o in options]
            else:
                audit += "I" * gaps[-1]
                options = [o + "".join(x) for o in options for x in itertools.product("ua", repeat=gaps[-1])]
                if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                    found.append((cost, audit))
    return min(found)


def program(kind):
    """(cost, audit) by a dynamic program over whole strings."""
    best = {"": (0, "")}
    nxt = {"": "u", "s": "u", "a": "u", "u": "a"}

    def insertions(b):
        for _ in range(3):
            for s, (c, w) in list(b.items()):
                b[nxt[s]] = min(b.get(nxt[s], (1 << 60, "")), (c + 2, w + "I"))
        return b

    for initial, must, cut in kind:
        new = {}
        for s, (c, w) in insertions(dict(best)).items():
            moves = [(s, 3, "D")]
            if not must:
                moves.append((nxt[s], 2 + cut, "R"))
                if initial and initial == nxt[s] or initial == "s" and s == "":
                    moves.append((initial, cut, "K"))
            for t, x, letter in moves:
                new[t] = min(new.get(t, (1 << 60, "")), (c + x, w + letter))
        best = new
    ends = insertions(dict(best))
    return min(ends[s] for s in ("", "a") if s in ends)


def repaired(rows, audit):
    out, state, left = [], "", iter(rows)
    for letter in audit:
        _, role, text = next(left) if letter != "I" else (None, "", "")
        if letter == "D":
            continue
        if letter == "K":
            state = role[:1]
        else:
            state = "a" if state == "u" else "u"
            role = {"u": "user", "a": "assistant"}[state]
        out.append(f"{role}:{text}")
    return out


def brute(rows):
    out = {}
    for c, mine in damaged(rows).items():
        kind, faults = kinds(mine)
        turns = {t for t, *_ in mine if t is not None}
        cost, audit = program(kind)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                  sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                  hashlib.sha256("\n".join(repaired(mine, audit)).encode()).hexdigest())
    return out


def search(kind):
    s, parts, most = op.Search(), [], 0
    for i, k in enumerate(kind):
        parts += s.put(k, i)
        most = max(most, s.held)
    parts += s.close()
    assert [r for _, r in parts if r is not None] == list(range(len(kind)))
    return (s.cost, "".join(p for p, _ in parts)), most


def random_kinds(rng, n):
    return [(rng.choice(["s", "u", "u", "a", "a", "t", ""]), rng.random() < 0.25, rng.random() < 0.25) for _ in range(n)]


def test_all_repairs_of_short_conversations():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n else 1):
            kind = random_kinds(rng, n)
            assert search(kind)[0] == program(kind) == exhaustive(kind), kind


def test_long_conversations_match_the_program():
    rng = random.Random(2)
    for _ in range(1500):
        kind = random_kinds(rng, rng.randrange(1, 30))
        assert search(kind)[0] == program(kind), kind


def test_same_kind_of_row_throughout():
    for initial in ("s", "u", "a", "t"):
        for must in (False, True):
            for cut in (False, True):
                for n in range(1, 12):
                    kind = [(initial, must, cut)] * n
                    assert search(kind)[0] == program(kind), kind


def test_survivors_coalesce():
    n = 20000
    assert search([("u", False, False), ("a", False, False)] * n)[1] < 20
    assert search([("u", True, False)] * n)[1] < 20
    rng = random.Random(4)
    usual = [(("u", "a")[i % 2] if rng.random() > 0.05 else "u", rng.random() < 0.1, rng.random() < 0.05) for i in range(n)]
    assert search(usual)[1] < 200
    # A system turn with nothing after it stays open: deleted it costs 3, with two insertions 4.
    assert search([("s", False, False)] + [("u", True, False)] * 50)[0] == (153, "D" * 51)
    # Rows that fit nowhere leave two repairs open to the end (an odd one goes first or not): all of it is held, and right.
    assert search([("t", False, False)] * 301)[0] == program([("t", False, False)] * 301)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    got = {r.conv_id: tuple(r)[1:] for r in op.op12_conversations(spark, SF).collect()}
    assert got == want


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rows_of(rng, convs, n):
    texts = ["Hello.", "Hello", "", " \n", "What? \t", "Fine!\r\n", "é…", None, "a:b.\nc."]
    out = [(rng.choice(convs), rng.choice([None, 0, 1, 2, 3, 4, 5, 9, -2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
            rng.choice(texts)) for _ in range(n)]
    return out + out[: n // 5]


@pytest.mark.parametrize("batch", ["3", "2000"])
def test_awkward_rows(spark, batch, monkeypatch):
    rng = random.Random(int(batch))
    rows = rows_of(rng, [None, *range(25)], 260) + rows_of(rng, [7], 120)
    monkeypatch.setitem(__import__("cairn.llm.common").llm.common.BATCH_CONF, "spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS kind", "1 AS edits", "2 AS n", "3 AS key")
    got = op.summaries(op.repair(op.damage(df), df)).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    want = brute(rows)
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_messages_are_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes."), (2, 0, "tool", "x")]
    got = [(r.conv_id, r.edit, r.role, r.text) for r in op.repair(spark.createDataFrame(rows, SCHEMA)).collect() if r.edit]
    assert [x[1:] for x in got if x[0] == 1] == [("K", "system", "Be kind."), ("K", "user", "Hi!"), ("I", "assistant", ""), ("K", "user", "Are you there?"), ("K", "assistant", "Yes.")]
    assert [x[1:] for x in got if x[0] == 2] == [("D", "tool", "x")]


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.summaries(op.repair(op.damage(df), df)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "Hi.")], SCHEMA)
    assert [tuple(r) for r in op.summaries(op.repair(op.damage(df), df)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
