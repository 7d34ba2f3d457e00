import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import exact_dedup as op


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def weak(text):
    return F.unhex(F.hex(F.substring(text, 1, 1).cast("binary")))


@pytest.mark.parametrize("digest", [op.sha256, weak])
def test_matches_brute_force(spark, digest):
    rows = [(i, ["", "a", "ab", "abc", "b", None][i % 6] if i % 5 else f"text {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    got = op.exact_dedup(docs, digest=digest, salts=3, salt_from=2).collect()
    by_id = dict(rows)
    assert len(got) == 60
    for r in got:
        assert (r.keep_id, r.group_size) == want[by_id[r.id] or ""]
    kept = op.keep_rows(docs, op.exact_dedup(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in want.values())


def test_state_goes_on_over_batches(spark, tmp_path):
    keys, state, ck = (str(tmp_path / x) for x in ("keys", "state", "ck"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    op.write_keys(first, keys, "doc_id", "text", op.sha256)
    op.run_state(spark, keys, state, ck, max_files_per_trigger=1)
    op.write_keys(spark.createDataFrame([(5, "a"), (4, "a")], "doc_id bigint, text string"), keys, "doc_id", "text", op.sha256)
    op.run_state(spark, keys, state, ck, max_files_per_trigger=1)
    got = {bytes(r.digest): (r.n, r.keep.id) for r in op.read_state(spark, state).collect()}
    assert got == {hashlib.sha256(b"a").digest(): (3, 5), hashlib.sha256(b"b").digest(): (1, 2)}


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = brute(rows)
    got = op.exact_dedup(awkward).collect()
    assert len(got) == len(rows) and sum(r.uid == r.keep_uid for r in got) == len(want)
    kept = op.keep_rows(awkward, op.exact_dedup(awkward))
    assert kept.columns == awkward.columns and kept.count() == len(want)
    assert sorted((r.text or "") for r in kept.collect()) == sorted(want)
    assert op.exact_dedup(empty).count() == 0 and op.keep_rows(empty, op.exact_dedup(empty)).count() == 0
