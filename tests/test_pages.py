"""Pages through an index against the whole table in order."""

import random

import pytest

from cairn.session import work_dir
from cairn.sources.pages import PageIndex


def order(r):
    return [(x is not None, x) for x in r[:2]]


def test_pages_by_offset_and_by_key(spark):
    rng = random.Random(2)
    rows = sorted({(rng.choice([None, *range(9)]), rng.choice([None, *"abcdefgh"]), 0) for _ in range(70)}, key=order)
    df = spark.createDataFrame(rows, "k int, j string, v int").orderBy("v")
    index = PageIndex.build(df, ["k", "j"], work_dir(spark, "t-pages"), part_rows=12)
    assert len(index.parts) > 2 and sum(n for _, n in index.parts) == len(rows)
    for limit, offset in ((5, 0), (30, 7), (1, len(rows) - 1), (10, len(rows) - 3), (5, len(rows) + 4)):
        assert [tuple(r) for r in index.page(limit, offset).collect()] == rows[offset:offset + limit]
    seen, key = [], None
    while page := [tuple(r) for r in PageIndex(spark, index.path, ["k", "j"]).after(key, 11).collect()]:
        seen += page
        key = page[-1][:2]
    assert seen == rows


def test_a_deep_page_opens_few_parts(spark):
    index = PageIndex.build(spark.range(10000).selectExpr("id", "id * 2 AS v"), ["id"], work_dir(spark, "t-deep"), part_rows=500)
    page = index.page(100, 9000)
    assert [r.id for r in page.collect()] == list(range(9000, 9100))
    assert len({f for f in page.inputFiles()}) <= 2
    assert len(index.after([8999], 100).inputFiles()) <= 2


def test_small_parts_need_no_more_tasks(spark):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("t-tasks", "")
    try:
        index = PageIndex.build(spark.range(20000, numPartitions=4), ["id"], work_dir(spark, "t-tasks"), part_rows=50)
        stages = {s for j in tracker.getJobIdsForGroup("t-tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(index.parts) == 400 and all(n == 50 for _, n in index.parts)
    assert max(tasks) < 50, tasks
    assert [r.id for r in index.page(3, 12345).collect()] == [12345, 12346, 12347]


def test_empty_table_and_order(spark):
    index = PageIndex.build(spark.range(0), ["id"], work_dir(spark, "t-none"))
    assert index.page(5).count() == 0 and index.after(None, 5).count() == 0
    with pytest.raises(ValueError):
        PageIndex.build(spark.range(3), [], work_dir(spark, "t-order"))
