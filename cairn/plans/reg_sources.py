"""Registered queries: scans, staging and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans.registry import register
from cairn.session import work_dir
from cairn.sources import io, paged
from cairn.sources.pages import PageIndex
from cairn.operators.profile import sample_hash
from cairn.streaming import streams


@register("scan_table", "S1", "SELECT * FROM orders")
def scan_table(spark, sf):
    return io.scan(spark, sf, "orders")


@register("scan_where", "S2", "SELECT * FROM lineitem WHERE l_quantity > 45")
def scan_where(spark, sf):
    return io.scan(spark, sf, "lineitem", where="l_quantity > 45")


@register("count_where", "S3",
          "SELECT count(*) AS total_rows FROM orders WHERE o_orderstatus = 'O'")
def count_where(spark, sf):
    return io.count_rows(io.scan(spark, sf, "orders"), "o_orderstatus = 'O'")


@register("scan_page", "S4", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def scan_page(spark, sf):
    return io.page(io.scan(spark, sf, "orders"), ["o_orderkey"], limit=100, offset=200)


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@register("scan_page_deep", "S4", f"""
SELECT * FROM lineitem ORDER BY {', '.join(_LINE_ORDER)} LIMIT 500 OFFSET (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM lineitem)""")
def scan_page_deep(spark, sf):
    """The page at nine tenths of lineitem, through a page index that opens the parts it needs."""
    lines = io.scan(spark, sf, "lineitem")
    index = PageIndex.build(lines, _LINE_ORDER, work_dir(spark, "pages"), part_rows=5000)
    return index.page(500, sum(n for _, n in index.parts) * 9 // 10)


@register("scan_page_after", "S4", f"""
SELECT * FROM (SELECT * FROM lineitem ORDER BY {', '.join(_LINE_ORDER)} LIMIT 700)
ORDER BY {', '.join(_LINE_ORDER)} LIMIT 300 OFFSET 400""")
def scan_page_after(spark, sf):
    """The rows 400 to 700 by key: the page after the one of the first 400."""
    index = PageIndex.build(io.scan(spark, sf, "lineitem"), _LINE_ORDER, work_dir(spark, "pages"), part_rows=5000)
    last = index.page(1, 399).first()
    return index.after([last[c] for c in _LINE_ORDER], 300)


@register("stage_export", "S6",
          "SELECT count(*) AS rows_written FROM orders WHERE o_orderstatus = 'F'")
def stage_export(spark, sf):
    path = work_dir(spark, "stage")
    _, rows = io.stage_export(io.scan(spark, sf, "orders"), path, "o_orderstatus = 'F'")
    return spark.createDataFrame([(rows,)], "rows_written bigint")


@register("stage_load", "S7", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def stage_load(spark, sf):
    path = work_dir(spark, "stage")
    io.stage_export(io.scan(spark, sf, "orders"), path, "o_orderstatus = 'F'")
    return io.stage_load(spark, path)


@register("write_result", "S8", """
SELECT f.format, (SELECT count(*) FROM orders) AS row_count, 6 AS column_count
FROM (VALUES ('csv'), ('parquet'), ('json')) AS f(format)""")
def write_result(spark, sf):
    orders = io.scan(spark, sf, "orders")
    rows = []
    for fmt in io.FORMATS:
        st = io.write_result(orders, work_dir(spark, f"result-{fmt}"), fmt)
        assert st["file_size"] > 0
        rows.append((fmt, st["row_count"], st["column_count"]))
    return spark.createDataFrame(rows, "format string, row_count bigint, column_count int")


@register("write_result_csv", "S8", "SELECT * FROM documents")
def write_result_csv(spark, sf):
    docs = io.scan(spark, sf, "documents")
    path = work_dir(spark, "result-csv")
    io.write_result(docs, path, "csv")
    return io.read_result(spark, path, "csv", docs.schema)


@register("write_result_json", "S8", "SELECT * FROM orders")
def write_result_json(spark, sf):
    orders = io.scan(spark, sf, "orders")
    path = work_dir(spark, "result-json")
    io.write_result(orders, path, "json")
    return io.read_result(spark, path, "json", orders.schema)


@register("write_sample", "S9", """
SELECT * FROM events
WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT < 0.1 * 4294967296""")
def write_sample(spark, sf):
    ev = io.scan(spark, sf, "events")
    path = work_dir(spark, "sample")
    io.write_result(sample_hash(ev, ["event_id"], 0.1), path, "parquet")
    return io.read_result(spark, path, "parquet")


@register("read_artifact_bytes", "S10",
          "SELECT concat(CAST(o_orderkey AS VARCHAR), ',', o_orderstatus) AS line FROM orders")
def read_artifact_bytes(spark, sf):
    path = work_dir(spark, "bytes")
    (io.scan(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
       .write.mode("overwrite").option("maxRecordsPerFile", 100_000).csv(path))
    content = io.read_content(spark, path, "*.csv")
    lines = content.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    return lines.where(F.col("line") != "")


@register("paged_scan", "S5", """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_linenumber <= 5 AND l_quantity > 10""")
def paged_scan(spark, sf):
    """lineitem read in key ranges by the paged source; two of the filters go to the client."""
    lines = paged.scan(spark, paged.ParquetPages(f"{sf}/lineitem.parquet"), "lineitem",
                       "l_orderkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz, l_returnflag string",
                       key="l_orderkey", parts=16)
    return lines.where("l_returnflag IN ('A', 'R') AND l_linenumber <= 5 AND l_quantity > 10")


@register("paged_incremental", "S5", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def paged_incremental(spark, sf):
    """orders taken into a replica by two runs of the paged stream; the second finds nothing above the last key."""
    root = work_dir(spark, "paged")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"
    for _ in range(2):
        rows = paged.stream(spark, paged.ParquetPages(f"{sf}/orders.parquet"), "orders", schema, key="o_orderkey", parts=8)
        streams.stream_into(rows, f"{root}/replica", f"{root}/_checkpoint")
    return streams.read_stream_replica(spark, f"{root}/replica")
