"""A remote table read in key ranges through Spark's Python data source API.

A *client* stands for the remote side and answers two questions: the bounds of an
integer key, and the rows of a key range, as Arrow batches of one page each.  ``SqlPages`` asks
any DB-API database, ``ParquetPages`` a table of Parquet files.  What Spark does with it:

* ``scan`` splits the key between its bounds into ranges, one task each; the first
  range is open below and the last above, so rows that come after the bounds were asked are
  read too, and rows without a key are a range of their own.  A task holds one page at a time.
* Comparisons with integers, strings, dates and booleans are pushed to the client
  (``pushFilters``), which also narrows the bounds; all others stay with Spark.  Only the columns asked for travel.
* ``stream`` reads what has a key above the last one taken; the offset is the greatest key, so a
  source that only adds greater keys is read exactly once.  Rows without a key are never taken.

A lost task reads its range again.  A table that changes during a scan is read as each range
finds it; a client that can pin a version (a snapshot, a transaction) should do so.

Edge cases.  An empty table, or one whose filters leave nothing, has no ranges.  A key of one value is one
range, so a range holds all rows of its keys however many; they still travel page by page.
"""

from __future__ import annotations

import datetime
import functools
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A condition on one column: (column, operator, value); operators are the keys of ``SqlPages.FORMS``.
Condition = tuple[str, str, object]


class KeyRange(NamedTuple):
    """Keys from ``low`` up to but without ``high`` (None: open), or the rows without a key."""
    low: int | None
    high: int | None
    null: bool = False

    def conditions(self, key: str) -> list[Condition]:
        if self.null:
            return [(key, "is null", None)]
        out: list[Condition] = [(key, "is not null", None)]
        if self.low is not None:
            out.append((key, ">=", self.low))
        if self.high is not None:
            out.append((key, "<", self.high))
        return out


class Pages(Protocol):
    """What a client answers; it is pickled to the tasks, so it opens its connection in each call."""

    def bounds(self, key: str, where: list[Condition]) -> tuple[int | None, int | None, bool]:
        """Least and greatest key, and whether rows without a key exist, among the rows that satisfy ``where``."""

    def pages(self, columns: list[str], where: list[Condition]) -> Iterator[pa.RecordBatch]:
        """The rows that satisfy ``where``, a page at a time."""


class SqlPages:
    """A table of a DB-API database: ``connect`` opens a connection, ``mark`` is its parameter mark."""

    #: How each operator is written; ``{}`` stands for the marks of its values.
    FORMS = {"=": "= {}", "<": "< {}", "<=": "<= {}", ">": "> {}", ">=": ">= {}", "in": "IN ({})",
             "is null": "IS NULL", "is not null": "IS NOT NULL"}

    def __init__(self, connect: Callable, table: str, mark: str = "?", page_rows: int = 10_000):
        self.connect, self.table, self.mark, self.page_rows = connect, table, mark, page_rows

    @staticmethod
    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def statement(self, select: str, where: list[Condition]) -> tuple[str, list]:
        texts, values = [], []
        for column, op, value in where:
            some = [] if value is None else list(value) if op == "in" else [value]
            texts.append(f"{self.quoted(column)} {self.FORMS[op].format(', '.join([self.mark] * len(some)))}")
            values += some
        text = f"SELECT {select} FROM {'.'.join(map(self.quoted, self.table.split('.')))}"
        return text + (" WHERE " + " AND ".join(texts) if texts else ""), values

    def _rows(self, select: str, where: list[Condition]) -> Iterator[list[tuple]]:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(*self.statement(select, where))
            while page := cursor.fetchmany(self.page_rows):
                yield page
        finally:
            connection.close()

    def bounds(self, key, where):
        name = self.quoted(key)
        (low, high, rows, keys), = next(self._rows(f"min({name}), max({name}), count(*), count({name})", where))
        return low, high, rows > keys

    def pages(self, columns, where):
        for page in self._rows(", ".join(map(self.quoted, columns)), where):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*page)], names=columns)


class ParquetPages:
    """A table of Parquet files that every executor can open; statistics leave out the row groups a range doesn't need."""

    def __init__(self, path: str, page_rows: int = 10_000):
        self.path, self.page_rows = path, page_rows

    def _plan(self, where: list[Condition]):
        """The table's schema, and per file the row groups that may hold rows that satisfy ``where``."""
        import pyarrow.compute as pc
        import pyarrow.dataset as files
        data, test = files.dataset(self.path), None
        for column, op, value in where:
            f = pc.field(column)
            one = {"=": lambda: f == value, "<": lambda: f < value, "<=": lambda: f <= value, ">": lambda: f > value,
                   ">=": lambda: f >= value, "in": lambda: f.isin([v for v in value if v is not None]),
                   "is null": f.is_null, "is not null": f.is_valid}[op]()
            test = one if test is None else test & one
        parts = [(p, [g.id for g in (p if test is None else p.subset(test, schema=data.schema)).row_groups]) for p in data.get_fragments(test)]
        return data.schema, parts

    def _read(self, schema: pa.Schema, part, groups: list[int], columns: list[str], where: list[Condition]) -> Iterator[pa.RecordBatch]:
        """Row groups of a file, decoded a page of rows at a time by this thread: nothing is read ahead or queued, so what is
        held doesn't grow with the table (a dataset's scanner queues up to 1 GB for a slow reader)."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        if not groups:
            return
        needed = [schema.field(c) for c in dict.fromkeys([*columns, *(c for c, _, _ in where)])]
        with part.open() as source, pq.ParquetFile(source, buffer_size=1 << 20, pre_buffer=False) as file:
            there = set(file.schema_arrow.names)
            for batch in file.iter_batches(self.page_rows, groups, [f.name for f in needed if f.name in there], use_threads=False):
                # A file may lack a column of the table, or have it in another type.
                rows = {f.name: batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in needed}
                page = pa.RecordBatch.from_arrays([rows[c] for c in columns], names=columns)
                passed = [self._holds(rows[column], op, value) for column, op, value in where]
                yield page.filter(functools.reduce(pc.and_kleene, passed)) if passed else page

    @staticmethod
    def _holds(values: pa.Array, op: str, value) -> pa.Array:
        """Which values satisfy a condition; null counts as no."""
        import pyarrow.compute as pc
        if op == "in":
            some = [pc.equal(values, v) for v in value if v is not None]
            return functools.reduce(pc.or_kleene, some) if some else pa.repeat(False, len(values))
        if op in ("is null", "is not null"):
            return pc.is_null(values) if op == "is null" else pc.is_valid(values)
        compare = {"=": pc.equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal}[op]
        return compare(values, value)

    def bounds(self, key, where):
        import pyarrow.compute as pc
        schema, parts = self._plan(where)
        groups = [(p, g, self._statistics(p, g, key)) for p, some in parts for g in some]
        # The outermost row groups first; most of the others lie between their keys and aren't read.
        known = [x for x in groups if x[2] is not None]
        first = [min(known, key=lambda x: x[2].min), max(known, key=lambda x: x[2].max)] if known else []
        low = high = None
        null = False
        for part, group, held in [*first, *groups]:
            if held is not None and low is not None and low <= held.min and held.max <= high and (null or held.null_count == 0):
                continue
            for batch in self._read(schema, part, [group], [key], where):
                if not batch.num_rows:
                    continue
                ends = pc.min_max(batch.column(0)).as_py()
                null = null or batch.column(0).null_count > 0
                if ends["min"] is not None:
                    low = ends["min"] if low is None else min(low, ends["min"])
                    high = ends["max"] if high is None else max(high, ends["max"])
        return low, high, null

    @staticmethod
    def _statistics(part, group: int, key: str):
        """Least and greatest key and number of nulls of a row group, if its file tells them."""
        meta = part.metadata.row_group(group)
        held = next((c.statistics for c in map(meta.column, range(meta.num_columns)) if c.path_in_schema == key), None)
        return held if held is not None and held.has_min_max and held.has_null_count else None

    def pages(self, columns, where):
        schema, parts = self._plan(where)
        for part, groups in parts:
            yield from (b for b in self._read(schema, part, groups, columns, where) if b.num_rows)


class Range(ds.InputPartition):
    def __init__(self, keys: KeyRange):
        super().__init__(tuple(keys))


def key_ranges(low: int | None, high: int | None, null: bool, parts: int) -> list[KeyRange]:
    """At most ``parts`` ranges of about equal width that cover all keys, and one for rows without a key."""
    out = []
    if low is not None:
        parts = max(1, min(parts, high - low + 1))
        cuts = [low + (high - low + 1) * i // parts for i in range(1, parts)]
        out = [KeyRange(a, b) for a, b in zip([None, *cuts], [*cuts, None])]
    return out + ([KeyRange(None, None, True)] if null else [])


#: How the filters that are pushed are written as conditions.
OPERATORS = {ds.EqualTo: "=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=",
             ds.In: "in", ds.IsNull: "is null", ds.IsNotNull: "is not null"}


def condition(f: ds.Filter) -> Condition | None:
    """A pushed filter as a condition; None where the remote side might compare otherwise than Spark."""
    op = OPERATORS.get(type(f))
    if op is None or len(f.attribute) != 1:
        return None
    value = getattr(f, "value", None)
    some = list(value) if op == "in" else [] if op.startswith("is") else [value]
    plain = all(isinstance(v, (int, str)) or type(v) is datetime.date for v in some)
    return (f.attribute[0], op, tuple(some) if op == "in" else value) if plain and (some or op != "in") else None


def read_range(client: Pages, schema: StructType, key: str, keys: KeyRange, where: list[Condition]) -> Iterator[pa.RecordBatch]:
    target = to_arrow_schema(schema)
    for page in client.pages(schema.names, where + keys.conditions(key)):
        yield pa.RecordBatch.from_arrays([page.column(f.name).cast(f.type) for f in target], schema=target)


class PagedReader(ds.DataSourceReader):
    def __init__(self, client: Pages, schema: StructType, key: str, parts: int):
        self.client, self.schema, self.key, self.parts = client, schema, key, parts
        self.where: list[Condition] = []

    def pushFilters(self, filters):
        for f in filters:
            if (one := condition(f)) is None:
                yield f
            else:
                self.where.append(one)

    def partitions(self):
        return [Range(r) for r in key_ranges(*self.client.bounds(self.key, self.where), self.parts)] or [Range(KeyRange(0, 0))]

    def read(self, partition):
        yield from read_range(self.client, self.schema, self.key, KeyRange(*partition.value), self.where)


class PagedStreamReader(ds.DataSourceStreamReader):
    """Offsets are ``{"next": key}``: all keys below are taken."""

    def __init__(self, client: Pages, schema: StructType, key: str, parts: int, after: int | None):
        self.client, self.schema, self.key, self.parts, self.after = client, schema, key, parts, after

    def initialOffset(self):
        return {"next": None if self.after is None else self.after + 1}

    def latestOffset(self):
        high = self.client.bounds(self.key, [])[1]
        return self.initialOffset() if high is None else {"next": high + 1}

    def partitions(self, start, end):
        low, high = start["next"], end["next"]
        if high is None or (low is not None and low >= high):
            return []
        if low is None:
            low = self.client.bounds(self.key, [(self.key, "<", high)])[0]
            if low is None:
                return []
        cuts = sorted({low + (high - low) * i // self.parts for i in range(self.parts)})
        return [Range(KeyRange(a, b)) for a, b in zip(cuts, [*cuts[1:], high])]

    def read(self, partition):
        yield from read_range(self.client, self.schema, self.key, KeyRange(*partition.value), [])


def source(spark: SparkSession, client: Pages, name: str, key: str, parts: int, after: int | None = None) -> str:
    """Register a data source over ``client`` in this session and return its format's name."""
    # Sent by value, so that executors need no copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    format_name = f"cairn_paged_{name}"

    class Paged(ds.DataSource):
        @classmethod
        def name(cls):
            return format_name

        def reader(self, schema):
            return PagedReader(client, schema, key, parts)

        def streamReader(self, schema):
            return PagedStreamReader(client, schema, key, parts, after)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
    return format_name


def scan(spark: SparkSession, client: Pages, name: str, schema: StructType | str, key: str, parts: int) -> DataFrame:
    """The columns of ``schema`` of a remote table, read in at most ``parts`` ranges of ``key`` and one for rows without it."""
    return spark.read.format(source(spark, client, name, key, parts)).schema(schema).load()


def stream(spark: SparkSession, client: Pages, name: str, schema: StructType | str, key: str, parts: int,
           after: int | None = None) -> DataFrame:
    """A stream of the rows whose key is above the last one taken (``after`` at first; None: all)."""
    return spark.readStream.format(source(spark, client, name, key, parts, after)).schema(schema).load()
