from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import line_dedup as op

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars, min_docs):
    """Rows of distinct ids."""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 3), (4, 3), (9, 2)])
def test_matches_brute_force(spark, batches, fanout):
    pool = ["common line here", "  Common LINE here\t", "É common line", "é common line", "short", "", "other line 12345"]
    rows = [(i, "\n".join(pool[(i * 7 + j * (i % 3 + 1)) % 7] for j in range(i % 6))) for i in range(40)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: (r.n_lines, r.n_dropped, r.kept) for r in
           op.dedup_lines(docs, min_chars=10, min_docs=3, batches=batches, fanout=fanout).collect()}
    assert got == brute(rows, 10, 3)


def test_runs_are_levelled_and_decided_keys_not_stored_again(spark, tmp_path):
    runs = op.LineRuns(spark, str(tmp_path), min_docs=2, fanout=2)
    batch = lambda *rows: spark.createDataFrame([(k.encode(), i) for k, i in rows], "key binary, id bigint")
    runs.add(batch(("a", 9), ("a", 8), ("b", 9)))
    runs.add(batch(("a", 5), ("b", 4), ("c", 4)))
    runs.add(batch(("a", 1), ("b", 2), ("c", 3)))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert {bytes(r.key): (r.n_docs, r.keeper) for r in runs.view().collect()} == {b"a": (2, 9), b"b": (2, 9), b"c": (2, 4)}


def test_awkward_rows(spark, awkward, empty):
    got = op.dedup_lines(awkward, min_chars=3, min_docs=2).collect()
    assert len(got) == awkward.count()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.n_lines, r.n_dropped, r.kept))
    assert by[0] == [(1, 0, "")] and by[1] == [(1, 0, "")]
    assert by[5] == [(1, 1, "")] and by[7][0][1] == 0  # the largest id holding the line keeps it
    assert len(by[3]) == 3 and all(x == (1, 0, "one") for x in by[3])  # one document, three rows
    assert op.dedup_lines(empty).count() == 0
    nulls = spark.createDataFrame([(None, "the same line"), (1, "the same line")], "doc_id bigint, text string")
    got = {r.id: r.n_dropped for r in op.dedup_lines(nulls, min_chars=3, min_docs=2).collect()}
    assert got == {None: 1, 1: 0}


def test_no_python_on_executors(spark, awkward):
    plan = op.dedup_lines(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_time_is_linear_in_the_lines(spark):
    """Six documents that share all their lines: five lose them all."""
    import time
    spent = []
    for n in (8000, 32000):
        text = "\n".join(f"line number {i} with more than forty characters in it" for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id bigint, text string")
        t = time.time()
        got = {r.id: r for r in op.dedup_lines(docs, batches=1).collect()}
        spent.append(time.time() - t)
        assert got[5].n_dropped == 0 and got[5].kept == text
        assert all(got[i].n_dropped == n and got[i].kept == "" for i in range(5))
    assert spent[1] < 4 * spent[0] + 5


def test_rows_of_one_id_keep_their_own_places(spark):
    common = "a line of more than forty characters, the same in all"
    rows = [(i, common) for i in range(2, 7)] + [(1, f"x\n{common}\ny"), (1, f"{common}\nz\n{common}"), (1, "w"), (1, f"x\n{common}\ny")]
    got = op.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.kept for r in got if r.id == 1) == ["w", "x\ny", "x\ny", "z"]
    assert [r.kept for r in got if r.id == 6] == [common]
