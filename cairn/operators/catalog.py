"""Table catalog (C1-C8): the allow-list of replicated tables, its tags and
metadata, folded from an action log and queried as DataFrames.

Catalog-sized sides (the allow-list, tag lists, metadata) are joined without a
broadcast hint: AQE turns the join into a broadcast only when the runtime size
of that side is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``, which
is the size check, and keeps a shuffle join beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["schema_name", "table_name"]
#: Parts into which the actions of one table are spread where they meet a row per table.
SALTS = 16


def catalog_state(actions: DataFrame, source_tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold add/remove actions (ordered by ts, action_id) to the current
    catalog, and list the actions that are errors.

    Rules: an add of a table new to the catalog needs the table in the source;
    a remove of a table the catalog does not know is an error; re-adding an
    inactive table reactivates it and renews created_at, keeping the id; adding
    an active table changes nothing.  The final status is that of the last
    action; created_at is the last add that directly follows a remove (or the
    first add).

    Done with grouped aggregations only (no window over a table's actions):
      1. per key: first add, last add, last action;
      2. last remove before the last add (r*);
      3. first add after r* = created_at.
    Actions meet the per-key rows of an earlier step by key and a salt of their
    id, and are partially aggregated before the shuffle by key, so the actions
    of a table with a third of all are spread over ``SALTS`` tasks.
    """
    pos = F.struct("ts", "action_id")
    a = actions.withColumn("_salt", F.pmod(F.xxhash64("action_id"), F.lit(SALTS)))
    every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    stats = (actions.groupBy(*KEY).agg(
        F.min(F.when(F.col("action") == "add", pos)).alias("first_add"),
        F.max(F.when(F.col("action") == "add", pos)).alias("last_add"),
        F.max_by("action", pos).alias("last_action"))
        .join(source_tables.select(*KEY).distinct().withColumn("_in_source", F.lit(True)), KEY, "left"))
    known = stats.where(F.col("first_add").isNotNull() & F.col("_in_source").isNotNull())

    def meet(side: DataFrame) -> DataFrame:
        return a.join(side.withColumn("_salt", every_salt), [*KEY, "_salt"])

    r_star = (meet(known.select(*KEY, "first_add", "last_add")).where(pos >= F.col("first_add")).groupBy(*KEY).agg(
        F.first("first_add").alias("first_add"),
        F.max(F.when((F.col("action") == "remove") & (pos < F.col("last_add")), pos)).alias("r_star")))
    activation = (meet(r_star)
                  .where((F.col("action") == "add") & (pos >= F.col("first_add"))
                         & (F.col("r_star").isNull() | (pos > F.col("r_star"))))
                  .groupBy(*KEY).agg(F.min(pos).alias("activation")))
    state = (known.join(activation, KEY, "inner").select(
        *KEY,
        F.concat(F.lit("t"), F.col("first_add.action_id").cast("string")).alias("table_id"),
        F.when(F.col("last_action") == "add", F.lit("active")).otherwise(F.lit("inactive")).alias("status"),
        F.col("activation.ts").alias("created_at")))

    # Errors: every action of a table that never became known, and removes
    # that come before the first add of a known table.
    err = (meet(stats.select(*KEY, "first_add", "_in_source"))
           .where(F.col("first_add").isNull() | F.col("_in_source").isNull() | (pos < F.col("first_add")))
           .select("action_id", *KEY, "action", "ts",
                   F.when((F.col("action") == "add") & F.col("_in_source").isNull(),
                          F.lit("table not found in source"))
                    .otherwise(F.lit("table not in catalog")).alias("error")))
    return state, err


def catalog_remove(state: dict[str, DataFrame], ids: DataFrame, hard: bool = False
                   ) -> dict[str, DataFrame]:
    """Remove tables and what depends on them.

    Soft: the table turns inactive and its jobs go.  Hard: tags, metadata and
    the catalog row go too.  Every dependent table is one left anti join with
    the removed ids."""
    ids = ids.select("table_id").distinct()
    out = dict(state)
    out["sync_jobs"] = state["sync_jobs"].join(ids, "table_id", "left_anti")
    if hard:
        for name in ("allowed_tables", "table_tags", "table_metadata"):
            out[name] = state[name].join(ids, "table_id", "left_anti")
    else:
        flagged = ids.withColumn("_removed", F.lit(True))
        at = state["allowed_tables"].join(flagged, "table_id", "left")
        out["allowed_tables"] = at.withColumn(
            "status", F.when(F.col("_removed"), F.lit("inactive")).otherwise(F.col("status"))
        ).drop("_removed").select(*state["allowed_tables"].columns)
    return out


def allowed_only(df: DataFrame, catalog: DataFrame, key: str = "table_id") -> DataFrame:
    """Keep rows that belong to active registered tables."""
    active = catalog.where(F.col("status") == "active").select(F.col("table_id").alias(key))
    return df.join(active, key, "left_semi")


def list_allowed(catalog: DataFrame) -> DataFrame:
    """C4: every registered table."""
    return catalog.select("table_id", "schema_name", "table_name", "source", "status", "created_at")


def tag_lists(tags: DataFrame, key: str = "table_id") -> DataFrame:
    """Sorted, distinct tag list per key (nulls dropped)."""
    return tags.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def table_metadata(catalog: DataFrame, meta: DataFrame, tags: DataFrame,
                   table_ids: DataFrame | None = None) -> DataFrame:
    """Active tables with their metadata (missing numbers as 0) and tag
    list (an empty list when there are none, D7)."""
    active = catalog.where(F.col("status") == "active")
    if table_ids is not None:
        active = active.join(table_ids.select("table_id"), "table_id", "left_semi")
    out = (active.join(meta, "table_id", "left").join(tag_lists(tags), "table_id", "left"))
    return out.select(
        "table_id", "table_name", "schema_name", "source",
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
        F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
        F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"),
        "last_updated", "description",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def schema_inventory(spark: SparkSession, root: str, tables: Sequence[str]) -> DataFrame:
    """Rows, bytes and last modification per table of a folder.

    Row counts come from one aggregation per table (answered from parquet
    footers with aggregate pushdown), unioned into one plan; bytes and times
    come from a file listing that never opens the files."""
    from cairn.sources.io import file_listing
    root = root.rstrip("/")
    counts = None
    for t in tables:
        c = spark.read.parquet(f"{root}/{t}.parquet").agg(
            F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(t))
        counts = c if counts is None else counts.unionByName(c)
    files = (file_listing(spark, root, "*.parquet")
             .withColumn("table_name", F.regexp_extract("path", r"([^/]+)\.parquet$", 1))
             .groupBy("table_name")
             .agg(F.sum("length").cast("bigint").alias("size_bytes"),
                  F.max("modificationTime").alias("last_modified")))
    return counts.join(files, "table_name", "left").select("table_name", "row_count",
                                                          "size_bytes", "last_modified")


def find_by_tag(catalog: DataFrame, tags: DataFrame, meta: DataFrame,
                wanted_tags: Sequence[str] = (), text: str | None = None) -> DataFrame:
    """Active tables carrying any of the wanted tags or whose description
    contains the text (case-insensitive)."""
    active = catalog.where(F.col("status") == "active")
    hits = tags.where(F.col("tag").isin(list(wanted_tags))).select("table_id") if wanted_tags else None
    if text:
        by_text = meta.where(F.lower("description").contains(text.lower())).select("table_id")
        hits = by_text if hits is None else hits.unionByName(by_text)
    if hits is None:
        return active.where(F.lit(False))
    return active.join(hits, "table_id", "left_semi")


def list_data(catalog: DataFrame, meta: DataFrame, tags: DataFrame) -> DataFrame:
    """Every active table with source, tags and metadata, by schema and name."""
    return table_metadata(catalog, meta, tags).orderBy("schema_name", "table_name")
