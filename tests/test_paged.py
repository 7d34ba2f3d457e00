"""The paged data source (S5): ranges, pushed filters, pages, offsets."""

import datetime
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from cairn.sources import paged
from cairn.streaming import streams


def write_rows(path, rows):
    pq.write_table(pa.table({"k": pa.array([r[0] for r in rows], pa.int64()), "s": pa.array([r[1] for r in rows], pa.string()),
                             "x": pa.array([r[2] for r in rows], pa.float64())}), path, row_group_size=50)


def sample(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice([None, 7, rnd.randrange(-500, 500)]), rnd.choice([None, "", "a", "ä", "b'\""]), rnd.choice([None, 1.5, float("nan")]))
            for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 5000])
def test_ranges_cover_every_key_once(parts):
    ranges = paged.key_ranges(-3, 40, True, parts)
    assert len(ranges) <= min(parts, 44) + 1 and ranges[-1].null
    for key in range(-10, 60):
        held = [r for r in ranges if not r.null and (r.low is None or key >= r.low) and (r.high is None or key < r.high)]
        assert len(held) == 1
    assert paged.key_ranges(None, None, False, parts) == []
    assert paged.key_ranges(5, 5, False, parts) == [paged.KeyRange(None, None)]


@pytest.mark.parametrize("test", [
    "true", "k = 7", "k >= -20 AND k < 100", "k IS NULL", "s IN ('a', 'ä')", "s = ''", "s IS NULL AND k > 3", "x > 1", "NOT s = 'a'", "k <=> NULL",
    "s > 'a'", "k > 10000"])
def test_scan_equals_spark(spark, tmp_path, test):
    path = str(tmp_path / "t.parquet")
    write_rows(path, sample(400))
    got = paged.scan(spark, paged.ParquetPages(path, 64), "t", "k bigint, s string, x double", "k", 6).where(test)
    want = spark.read.parquet(path).where(test)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_columns_and_filters_reach_the_client(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write_rows(path, sample(300))
    reader = paged.PagedReader(paged.ParquetPages(path, 10), None, "k", 4)
    kept = list(reader.pushFilters([ds.GreaterThan(("k",), 400), ds.GreaterThan(("x",), 1.0), ds.Not(ds.EqualTo(("s",), "a"))]))
    assert [type(f) for f in kept] == [ds.GreaterThan, ds.Not] and reader.where == [("k", ">", 400)]
    pages = list(reader.client.pages(["s"], reader.where))
    assert all(p.schema.names == ["s"] and 0 < p.num_rows <= 10 for p in pages)
    low, high, null = reader.client.bounds("k", reader.where)
    assert low > 400 and high < 500 and not null


def test_a_slow_reader_holds_no_more_than_a_few_pages(tmp_path):
    path = str(tmp_path / "t.parquet")
    rng = random.Random(3)
    column = pa.array([rng.random() for _ in range(1_000_000)])
    with pq.ParquetWriter(path, pa.schema([("k", pa.int64()), ("x", pa.float64())])) as out:
        for i in range(4):
            out.write_table(pa.table({"k": pa.array(range(i * 1_000_000, (i + 1) * 1_000_000)), "x": column}))
    pages = paged.ParquetPages(path).pages(["k", "x"], paged.KeyRange(5, None).conditions("k"))
    before, rows, most = pa.total_allocated_bytes(), 0, 0
    for page in pages:
        rows += page.num_rows
        if rows < 200_000:
            time.sleep(0.02)
        most = max(most, pa.total_allocated_bytes() - before)
    # 64 MB of values; the data set's scanner held all of a million rows and more.
    assert rows == 3_999_995 and most < 12 << 20


def test_files_of_other_columns_and_types(spark, tmp_path):
    pq.write_table(pa.table({"k": pa.array([1, 2, None], pa.int64()), "s": ["a", "b", None]}), str(tmp_path / "a.parquet"))
    pq.write_table(pa.table({"k": pa.array([3, 4], pa.int32())}), str(tmp_path / "b.parquet"))
    client = paged.ParquetPages(str(tmp_path))
    got = [tuple(r.values()) for p in client.pages(["s", "k"], [("k", ">", 1)]) for r in p.to_pylist()]
    assert sorted(got, key=lambda r: r[1]) == [("b", 2), (None, 3), (None, 4)]
    assert client.bounds("k", []) == (1, 4, True) and sum(p.num_rows for p in client.pages(["s"], [("s", "is null", None)])) == 3


def test_empty_and_keyless_tables(spark, tmp_path):
    for name, rows in (("none", []), ("nulls", [(None, "a", 1.0)] * 5)):
        path = str(tmp_path / f"{name}.parquet")
        write_rows(path, rows)
        assert paged.scan(spark, paged.ParquetPages(path), name, "k bigint, s string", "k", 4).count() == len(rows)


def test_stream_takes_greater_keys_once(spark, tmp_path):
    path, target, mark = (str(tmp_path / x) for x in ("t.parquet", "replica", "ckpt"))
    rows = [(i, str(i), None) for i in range(-5, 60)]

    def run():
        src = paged.stream(spark, paged.ParquetPages(path, 16), "grows", "k bigint, s string", "k", 3)
        streams.stream_into(src, target, mark)
        return sorted((r.k, r.s) for r in streams.read_stream_replica(spark, target).collect())

    write_rows(path, rows + [(None, "never", None)])
    assert run() == [r[:2] for r in rows] == run()
    rows += [(i, "new", None) for i in range(60, 90)]
    write_rows(path, rows)
    assert run() == [r[:2] for r in rows]


class Cursor:
    """A cursor that notes what it is asked and gives rows it was made with."""

    def __init__(self, log, rows):
        self.log, self.rows = log, list(rows)

    def execute(self, text, values):
        self.log.append((text, values))

    def fetchmany(self, n):
        page, self.rows = self.rows[:n], self.rows[n:]
        return page


class Connection:
    def __init__(self, log, rows):
        self.log, self.rows = log, rows

    def cursor(self):
        return Cursor(self.log, self.rows)

    def close(self):
        self.log.append("closed")


def test_statements_of_a_database_client():
    log = []
    client = paged.SqlPages(lambda: Connection(log, [(1, "a"), (2, None), (3, "c")]), 'sales.odd"name', page_rows=2)
    where = [("s", "in", ("a", "b")), ("d", ">=", datetime.date(2024, 1, 1)), *paged.KeyRange(1, 9).conditions("k")]
    pages = list(client.pages(["k", "s"], where))
    assert [p.to_pydict() for p in pages] == [{"k": [1, 2], "s": ["a", None]}, {"k": [3], "s": ["c"]}]
    assert log == [('SELECT "k", "s" FROM "sales"."odd""name" WHERE "s" IN (?, ?) AND "d" >= ? AND "k" IS NOT NULL AND "k" >= ? AND "k" < ?',
                    ["a", "b", datetime.date(2024, 1, 1), 1, 9]), "closed"]
    client = paged.SqlPages(lambda: Connection(log, [(3, 8, 10, 9)]), "t")
    assert client.bounds("k", []) == (3, 8, True)
    assert log[-2] == ('SELECT min("k"), max("k"), count(*), count("k") FROM "t"', [])
