"""Text profiles by sketches against the exact ones."""

import random

from cairn.operators import profile


def test_top_and_freq_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", None, f"v{rng.randrange(400)}"]), f"u{i}", None, rng.choice(["b", "a"]) if i > 1 else "ab"[i]) for i in range(2000)]
    rows += [(None, None, None, "ab"[i % 2]) for i in range(sum(r[3] == "a" for r in rows) + 1)]
    df = spark.createDataFrame(rows, "skewed string, unique string, nothing string, `two.of them` string")
    want = {r.column_name: r for r in profile.profile_text(df).collect()}
    for items, candidates in ((10000, 100), (64, 8)):
        got = {r.column_name: r for r in profile.profile_text_sketch(df, items=items, candidates=candidates).collect()}
        assert set(got) == set(want)
        for c, w in want.items():
            assert (got[c]["count"], got[c].top, got[c].freq) == (w["count"], w.top, w.freq), c
            assert abs(got[c].approx_unique - w["unique"]) <= 0.04 * w["unique"]
    assert profile.profile_text_sketch(df.limit(0)).count() == 4


def test_ties_go_to_the_smallest_value(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "é", "a", "B"] * 50], "t string")
    assert profile.profile_text_sketch(df).first().top == profile.profile_text(df).first().top == "B"
