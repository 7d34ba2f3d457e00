"""Table replication.

A replica is a set of parquet folders below ``<target>/data``, one per *attempt* of a
sync job, plus a log of numbered entries below ``<target>/_log`` (``CommitLog``: an entry is created only if its
number is free).  Data is written first and logged second; the log entry names the
attempt's folder and its schema.  A folder without a completed entry is never read (Y14), so a
run that dies half-way leaves nothing visible.  A job id that has a completed entry is done: running it again writes
nothing and returns that entry.  A run that throws logs a ``failed`` entry with the whole error and raises again.

Jobs may run at the same time.  A job reads the log once, works on what it saw, and commits under the
next number.  If other entries came in between, a job whose rows depend on what it saw (incremental, upsert, compact) starts
again from the new state when one of them changed the replica, so no row is copied twice; a job that doesn't (full,
stream batches) takes the next free number.

The current replica is every completed batch from the latest completed base
(full, upsert or compacted copy) onwards; only those folders are opened.
``vacuum`` deletes the folders that no reader needs any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.core import latest_per_key
from cairn.sources.commitlog import CommitLog

JOB_LOG_SCHEMA = ("job_id string, table_name string, strategy string, status string, "
                  "seq bigint, rows_processed bigint, total_rows bigint, last_value string, "
                  "error_message string, folder string, schema_json string, violations map<string, bigint>")

#: Strategies whose batch replaces all before it.
BASES = ("full", "upsert")
#: Attempts of a job that loses to other jobs.
ATTEMPTS = 20


class Snapshot:
    """The log as a job saw it."""

    def __init__(self, entries: list[dict]):
        self.entries = entries
        self.version = len(entries) - 1
        self.done = [e for e in entries if e["status"] == "completed"]
        self.base = max((e["seq"] for e in self.done if e["strategy"] in BASES), default=None)

    def completed(self, job_id: str) -> dict | None:
        """The entry of a job id that is done."""
        return next((e for e in self.done if e["job_id"] == job_id), None)

    def batches(self) -> list[dict]:
        """The completed entries that make up the replica: the latest base and those after it."""
        return [e for e in self.done if self.base is None or e["seq"] >= self.base]

    def schema(self) -> T.StructType:
        """Columns of all batches, each with the type of the latest one that has it."""
        fields: dict[str, T.StructField] = {}
        for e in self.batches():
            for f in T.StructType.fromJson(json.loads(e["schema_json"])).fields:
                fields[f.name] = f
        return T.StructType(list(fields.values()))

    def watermark(self) -> str | None:
        """Last non-null watermark of the completed jobs since the latest
        completed base (D5: an empty batch keeps the previous one).

        A base that logged no watermark leaves the position unknown: an
        incremental run would copy rows the base already holds, so that is
        an error rather than silent duplication."""
        last = max((e for e in self.done if e["last_value"] is not None), key=lambda e: e["seq"], default=None)
        if self.base is not None and (last is None or last["seq"] < self.base):
            raise ValueError("the latest full sync logged no watermark; pass watermark_col "
                             "to sync_full before syncing incrementally")
        return last["last_value"] if last else None


@dataclass
class Batch:
    """What a job writes: rows, how they count, and the watermark column or the value to carry on."""

    rows: DataFrame
    strategy: str
    total_rows: int | None = None
    watermark_col: str | None = None
    carry_watermark: str | None = None
    #: Declared types to conform the rows to.
    columns: DataFrame | None = None
    #: Whether the rows were read from the replica itself.
    rewrites: bool = False

    @property
    def depends(self) -> bool:
        """Whether the rows depend on what the replica held."""
        return self.rewrites or self.strategy == "incremental"


class Replica:
    """Paths and log of one replicated table."""

    def __init__(self, spark: SparkSession, root: str, table_name: str = "table"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.table_name = table_name
        self.data_path = f"{self.root}/data"
        self.log_path = f"{self.root}/_log"
        self.commits = CommitLog(spark, self.log_path)

    # -- job log -------------------------------------------------------------
    def log(self) -> DataFrame:
        return self.commits.frame(JOB_LOG_SCHEMA)

    def snapshot(self) -> Snapshot:
        return Snapshot(self.commits.entries())

    def completed(self, job_id: str) -> dict | None:
        """The log entry of a job id that is done."""
        return self.snapshot().completed(job_id)

    # -- reading -------------------------------------------------------------
    def current_batches(self) -> DataFrame:
        """Log rows of the batches that make up the replica."""
        return self.log().where(F.col("seq").isin([e["seq"] for e in self.snapshot().batches()]))

    def schema(self) -> T.StructType:
        return self.snapshot().schema()

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The replica.  Before the first completed sync it is empty and has no
        columns.  Columns that later batches added are null in earlier ones."""
        snapshot = snapshot or self.snapshot()
        folders = [f"{self.data_path}/{e['folder']}" for e in snapshot.batches()]
        if not folders:
            return self.spark.createDataFrame([], T.StructType([]))
        return self.spark.read.schema(snapshot.schema()).parquet(*folders)

    # -- writing -------------------------------------------------------------
    def run(self, job_id: str, plan: Callable[[Snapshot], Batch]) -> dict:
        """Run a job: ``plan`` gives its batch for the state it sees.  Returns the job's log entry."""
        for _ in range(ATTEMPTS):
            snapshot = self.snapshot()
            if done := snapshot.completed(job_id):
                return done
            batch = plan(snapshot)
            entry = self._write(snapshot, job_id, batch)
            if committed := self._commit(snapshot, entry, batch.depends):
                return committed
        raise RuntimeError(f"job {job_id} lost to other jobs {ATTEMPTS} times")

    def _commit(self, snapshot: Snapshot, entry: dict, depends: bool) -> dict | None:
        """Log an entry under the next free number; None if the job must start again."""
        seen = snapshot.version
        while not self.commits.put(seen + 1, entry):
            now = self.snapshot()
            if done := now.completed(entry["job_id"]):
                return done
            if depends and entry["status"] == "completed" and any(e["seq"] > seen for e in now.done):
                return None
            seen = now.version
        return {**entry, "seq": seen + 1}

    def _check_schema(self, snapshot: Snapshot, schema: T.StructType, strategy: str) -> None:
        """A batch on top of others may add columns; it may not change a type."""
        if strategy in BASES:
            return
        have = {f.name: f.dataType for f in snapshot.schema().fields}
        changed = [f"{f.name}: {have[f.name].simpleString()} -> {f.dataType.simpleString()}"
                   for f in schema.fields if f.name in have and have[f.name] != f.dataType]
        if changed:
            raise ValueError("column types changed, a full sync is needed: " + ", ".join(changed))

    def _write(self, snapshot: Snapshot, job_id: str, batch: Batch) -> dict:
        """Write a batch into a folder of its own and make its log entry."""
        # Every attempt has its own folder, so no run ever touches rows that are being read.
        folder = f"job={quote(job_id, safe='')}-{uuid.uuid4().hex[:12]}"
        job = {"job_id": job_id, "table_name": self.table_name, "strategy": batch.strategy, "status": "failed",
               "rows_processed": 0, "total_rows": batch.total_rows, "last_value": None, "error_message": None,
               "folder": folder, "schema_json": None, "violations": None}
        aggs = [F.count(F.lit(1)).alias("rows")]
        if batch.watermark_col:
            aggs.append(F.max(batch.watermark_col).cast("string").alias("wm"))
        obs = Observation()
        checks: list[tuple[str, str, Column]] = []
        try:
            rows, names = batch.rows, batch.rows.columns
            if batch.columns is not None:
                casts, checks = conform_columns(rows, batch.columns)
                names = [n for n, _ in casts]
                # The checks look at the values as they came, in the pass that writes the cast ones.
                rows = rows.select(*[c.alias(n) for n, c in casts], *[c.alias(f"__check{i}") for i, (_, _, c) in enumerate(checks)])
                aggs += [F.count_if(F.col(f"__check{i}")).alias(f"check{i}") for i in range(len(checks))]
            out = rows.observe(obs, *aggs).select(*["`" + n.replace("`", "``") + "`" for n in names])
            job["schema_json"] = out.schema.json()
            self._check_schema(snapshot, out.schema, batch.strategy)
            out.write.parquet(f"{self.data_path}/{folder}")
            got = obs.get
        except Exception as exc:
            job["error_message"] = str(exc)
            self._commit(snapshot, job, False)
            raise
        job["rows_processed"] = int(got["rows"])
        if batch.total_rows is None:
            job["total_rows"] = job["rows_processed"]
        if checks:
            job["violations"] = {f"{n}.{kind}": int(got[f"check{i}"]) for i, (n, kind, _) in enumerate(checks) if got[f"check{i}"]}
        if fatal := fatal_violations(job["violations"] or {}, batch.watermark_col):
            job["error_message"] = "values that may not be: " + ", ".join(fatal)
        elif job["rows_processed"] != job["total_rows"]:
            job["error_message"] = "row count differs from source count"
        else:
            job["status"] = "completed"
            job["last_value"] = got.get("wm") if batch.watermark_col else batch.carry_watermark
        return job

    def needed(self, snapshot: Snapshot) -> set[str]:
        """Folders that readers open."""
        return {e["folder"] for e in snapshot.batches()}

    def vacuum(self, grace_hours: float = 24.0) -> int:
        """Delete batch folders that the replica doesn't need and that were last
        changed more than ``grace_hours`` ago (running readers and attempts are
        younger).  Returns their number."""
        keep = self.needed(self.snapshot())
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.data_path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        before = jvm.System.currentTimeMillis() - int(grace_hours * 3_600_000)
        gone = 0
        for st in fs.listStatus(path):
            if st.getPath().getName() not in keep and st.getModificationTime() <= before:
                gone += bool(fs.delete(st.getPath(), True))
        return gone


def fatal_violations(violations: dict[str, int], watermark_col: str | None) -> list[str]:
    """Violations that fail a job: nulls in NOT NULL columns, and watermarks that didn't cast."""
    return sorted(f"{k} ({n})" for k, n in violations.items()
                  if k.endswith(".null_in_not_null") or watermark_col and k == f"{watermark_col}.cast_failed")


def _filtered(src: DataFrame, where: str | None) -> DataFrame:
    return src.where(F.expr(where)) if where else src


def sync_full(replica: Replica, src: DataFrame, job_id: str, where: str | None = None,
              check_total: bool = False, watermark_col: str | None = None,
              columns: DataFrame | None = None) -> dict:
    """Replace the replica with the whole (filtered) source.

    The new version is a new batch; it becomes visible only when its log row is
    written, so readers never see a half-replaced table and an empty source
    gives an empty replica.  ``check_total`` counts the source under the same
    predicate first (S3, a scan of no columns when unfiltered) and fails the
    job if the write saw a different number of rows (Y12).  ``watermark_col``
    records the largest key of the copy, taken during the write, so that
    incremental syncs can continue from this full copy.  ``columns`` (declared
    types) conforms the rows; what doesn't fit is counted in the same pass and logged as
    ``violations``, and nulls in NOT NULL columns or watermarks that don't cast fail the job."""
    def plan(_: Snapshot) -> Batch:
        total = None
        if check_total:
            from cairn.sources.io import count_rows
            total = int(count_rows(src, where).first()["total_rows"])
        return Batch(_filtered(src, where), "full", total, watermark_col, columns=columns)

    return replica.run(job_id, plan)


def last_logged_watermark(replica: Replica) -> object:
    """The watermark that an incremental sync continues from (``Snapshot.watermark``)."""
    return replica.snapshot().watermark()


def sync_incremental(replica: Replica, src: DataFrame, key: str, job_id: str,
                     where: str | None = None, last_value: object = "logged",
                     columns: DataFrame | None = None) -> dict:
    """Y2: append rows with ``key > last watermark`` (and the extra filter).

    Without an earlier watermark the whole source is copied.  The new
    watermark is the largest key of the batch, taken during the write; an empty
    batch keeps the previous one (it logs no value).  A job id that is done is
    not run again, so a retry after a lost answer appends nothing twice."""
    def plan(seen: Snapshot) -> Batch:
        after = seen.watermark() if last_value == "logged" else last_value
        df = _filtered(src, where)
        if after is not None:
            df = df.where(F.col(key) > F.lit(after).cast(src.schema[key].dataType))
        return Batch(df, "incremental", watermark_col=key, columns=columns)

    return replica.run(job_id, plan)


def compact(replica: Replica, job_id: str, watermark_col: str | None = None) -> dict:
    """Rewrite the current replica (a base and its incremental batches) as one
    new base batch, so reads list and open one batch again.

    It reads the old batch folders and writes a new one, so nothing is
    overwritten in place; the old batches stop being read once the new
    base's log row exists.  The watermark is carried over: the largest
    ``watermark_col`` of the data if given, else the last logged one.  A
    replica that was never synced has nothing to compact, which is an error."""
    def plan(seen: Snapshot) -> Batch:
        if not seen.done:
            raise ValueError("the replica has no completed sync")
        carried = None if watermark_col else seen.watermark()
        return Batch(replica.read(seen), "full", None, watermark_col, carried, rewrites=True)

    return replica.run(job_id, plan)


def sync_upsert(replica: Replica, delta: DataFrame, keys: Sequence[str], job_id: str,
                version_col: str | None = None, watermark_col: str | None = None) -> dict:
    """Y3 on a replica: the upserted table is written as its next base batch, with a log row.

    The watermark is the largest ``watermark_col`` if given; otherwise the last logged one, if any, is carried."""
    def plan(seen: Snapshot) -> Batch:
        current = replica.read(seen) if seen.done else replica.spark.createDataFrame([], delta.schema)
        carried = next((e["last_value"] for e in reversed(seen.batches()) if e["last_value"] is not None), None)
        return Batch(upsert(current, delta, keys, version_col), "upsert", None, watermark_col,
                     None if watermark_col else carried, rewrites=True)

    return replica.run(job_id, plan)


def upsert(target: DataFrame, delta: DataFrame, keys: Sequence[str],
           version_col: str | None = None) -> DataFrame:
    """Apply new and modified rows to a table: one row per key of the delta,
    the latest version winning over the union of both.

    Within the delta the largest version wins, then (or without a version) the
    largest row.  If the target has the version column too, a target row with a
    greater version stays and the delta's row for that key is dropped; otherwise the delta wins.
    A null version is less than any other.  Keys match null-safely.

    Only the delta is aggregated (``max_by`` per key, partial per partition so
    a key updated millions of times is reduced before it moves).  The target
    is then filtered by a left anti join on the keys: when the delta is small
    AQE broadcasts it and the target is read in one map-side pass with no
    shuffle; a large delta falls back to a sort-merge anti join."""
    keys = list(keys)
    cols = target.columns
    ver = [F.col(version_col).alias("_ver")] if version_col else []
    whole = F.struct(*[c for c in cols if c not in keys] or [F.lit(0).alias("_")])
    d = delta.select(*cols, *ver)
    latest = latest_per_key(d, keys, ["_ver", whole] if version_col else [whole])

    def same(a: DataFrame, b: DataFrame) -> Column:
        cond = F.lit(True)
        for k in keys:
            cond = cond & a[k].eqNullSafe(b[k])
        return cond

    def newer(a: Column, b: Column) -> Column:
        return F.coalesce(a > b, a.isNotNull() & b.isNull())

    replaced, beaten = same(target, latest), None
    if version_col and version_col in cols:
        replaced = replaced & ~newer(target[version_col], latest["_ver"])
        holders = target.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col(version_col).alias("_hver"))
        beaten = newer(holders["_hver"], latest["_ver"])
        for i, k in enumerate(keys):
            beaten = beaten & latest[k].eqNullSafe(holders[f"_h{i}"])
    kept = target.join(latest, replaced, "left_anti")
    winners = latest if beaten is None else latest.join(holders, beaten, "left_anti")
    return kept.unionByName(winners.select(*cols))


def sync_snapshot(src: DataFrame, target: str, snapshot_ts: str,
                  where: str | None = None) -> str:
    """A point-in-time copy in its own ``snapshot`` partition.

    Dynamic partition overwrite replaces only this snapshot, so a rerun is
    harmless and other snapshots stay."""
    sid = snapshot_id(snapshot_ts)
    (_filtered(src, where).withColumn("snapshot", F.lit(sid))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot").parquet(target))
    return sid


def snapshot_id(ts: str) -> str:
    """Sortable partition value for a snapshot time: ``sYYYYMMDDTHHMMSS``."""
    digits = ts.replace("-", "").replace(":", "").replace(" ", "T")
    return f"s{digits}"


def snapshot_as_of(spark: SparkSession, target: str, ts: str) -> DataFrame:
    """The last snapshot taken at or before ``ts``.

    The snapshot id comes from the names of the partition folders, then is used
    as a literal so the scan reads that partition only."""
    all_snaps = spark.read.parquet(target)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    ids = [n.split("=", 1)[1] for n in names if n.startswith("snapshot=")]
    last = max((i for i in ids if i <= snapshot_id(ts)), default=None)
    if last is None:
        return all_snaps.where(F.lit(False)).drop("snapshot")
    return all_snaps.where(F.col("snapshot") == F.lit(last)).drop("snapshot")


# -- declared types ------------------------------------------------------------

# The source-to-replica type map of the reference.
REPLICA_TYPE = {
    "NUMBER": "DOUBLE",
    "FLOAT": "DOUBLE",
    "VARCHAR": "VARCHAR",
    "CHAR": "VARCHAR",
    "TEXT": "VARCHAR",
    "BOOLEAN": "BOOLEAN",
    "DATE": "DATE",
    "TIMESTAMP_NTZ": "TIMESTAMP",
    "TIMESTAMP_TZ": "TIMESTAMP",
    "TIMESTAMP_LTZ": "TIMESTAMP",
}

_SPARK_TYPE = {"DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date",
               "TIMESTAMP": "timestamp_ntz", "VARCHAR": "string"}


def _map_lookup(mapping: dict, col: Column, default: str) -> Column:
    lit_map = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(lit_map, col), F.lit(default))


def describe_columns(desc: DataFrame) -> DataFrame:
    """Parse declared types such as ``VARCHAR(16777216)`` or ``NUMBER(38,0)``
    into base type, max_length (text types), precision and scale (NUMBER and
    DECIMAL, scale 0 when only precision is given), is_nullable and the replica
    type (``VARCHAR(n)`` when a length is known)."""
    t = F.upper(F.trim(F.col("declared_type")))
    base = F.trim(F.regexp_extract(t, r"^([^(]+)", 1))
    has_args = t.contains("(")
    first = F.regexp_extract(t, r"\(\s*(\d+)", 1)
    second = F.regexp_extract(t, r",\s*(\d+)\s*\)", 1)
    is_text = base.isin("VARCHAR", "CHAR", "TEXT")
    is_num = base.isin("NUMBER", "DECIMAL")
    max_length = F.when(has_args & is_text & (first != ""), first.cast("bigint"))
    precision = F.when(has_args & is_num & (first != ""), first.cast("int"))
    scale = F.when(has_args & is_num, F.when(second != "", second.cast("int")).otherwise(F.lit(0)))
    rtype = _map_lookup(REPLICA_TYPE, base, "VARCHAR")
    rtype = F.when((rtype == "VARCHAR") & max_length.isNotNull(),
                   F.concat(F.lit("VARCHAR("), max_length.cast("string"), F.lit(")"))).otherwise(rtype)
    return desc.select(
        "table_name", "ordinal", F.col("name").alias("column_name"),
        base.alias("base_type"), max_length.alias("max_length"), precision.alias("precision"),
        scale.alias("scale"),
        F.when(F.col("nullable") == "Y", F.lit("YES")).otherwise(F.lit("NO")).alias("is_nullable"),
        rtype.alias("replica_type"))


def conform_schema(df: DataFrame, columns: DataFrame, exact: bool = False
                   ) -> tuple[DataFrame, DataFrame]:
    """Cast a source table to its declared replica types and count what
    does not fit: values that do not cast, nulls in NOT NULL columns and text
    longer than its declared length.

    The column list is table metadata (one row per column), so it is read to
    the driver to build the projection; the data itself is cast and checked in
    a single aggregation pass.  ``exact=True`` keeps NUMBER(p,s) as
    ``decimal(p,s)`` instead of the reference's DOUBLE."""
    casts, checks = conform_columns(df, columns, exact)
    conformed = df.select(*[c.alias(n) for n, c in casts])
    agg = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(checks)])
    violations = agg.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("check_name"), F.col(f"c{i}").alias("violations"))
        for i, (n, k, _) in enumerate(checks)])))
    return conformed, violations


def conform_columns(df: DataFrame, columns: DataFrame, exact: bool = False
                    ) -> tuple[list[tuple[str, Column]], list[tuple[str, str, Column]]]:
    """Per declared column (name, cast value), and per check (column, check, whether a row breaks it)."""
    specs = describe_columns(columns).orderBy("ordinal").collect()
    casts, checks = [], []
    for s in specs:
        name = s["column_name"]
        base = s["base_type"]
        if exact and base in ("NUMBER", "DECIMAL"):
            stype = f"decimal({s['precision'] or 38},{s['scale'] or 0})"
        else:
            stype = _SPARK_TYPE[REPLICA_TYPE.get(base, "VARCHAR")]
        src = df[f"`{name.replace('`', '``')}`"]
        if stype == "string" and dict(df.dtypes).get(name) not in ("string", None):
            if dict(df.dtypes)[name].startswith(("array", "map", "struct")):
                cast = F.to_json(src)
            else:
                cast = src.cast("string")
        elif base == "TIMESTAMP_TZ" or base == "TIMESTAMP_LTZ":
            cast = src.try_cast("timestamp").cast("timestamp_ntz")
        else:
            cast = src.try_cast(stype)
        casts.append((name, cast))
        checks.append((name, "cast_failed", src.isNotNull() & cast.isNull()))
        if s["is_nullable"] == "NO":
            checks.append((name, "null_in_not_null", src.isNull()))
        if s["max_length"] is not None:
            checks.append((name, "too_long", F.length(cast.cast("string")) > F.lit(s["max_length"])))
    return casts, checks


def high_watermark(df: DataFrame, key: str) -> DataFrame:
    """Largest incremental key of a batch."""
    return df.agg(F.max(key).alias("high_watermark"))


def last_watermark(jobs: DataFrame) -> DataFrame:
    """Per table, the watermark of the last completed job that stored one
    (D5: a full sync or an empty batch does not reset it)."""
    done = jobs.where((F.col("status") == "completed") & F.col("last_value").isNotNull())
    return (done.groupBy("table_id")
            .agg(F.max_by("last_value", F.struct("completed_at", "job_id")).alias("last_value")))


def table_stats(spark: SparkSession, path: str) -> DataFrame:
    """Row count (a scan of no columns) and bytes on disk."""
    from cairn.sources.io import file_listing
    size = (file_listing(spark, path).where(F.col("path").endswith(".parquet"))
            .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"])
    return (spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
            .withColumn("size_bytes", F.lit(int(size)).cast("bigint")))


def reconcile(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compare a source with its replica after a sync.

    One row per check: row counts, columns that one side lacks, per-column types
    (1 when the replica's type differs) and null counts, rows only in the source,
    rows only in the replica and keys whose rows differ.  The hash of a row covers for each
    column whether it is null, so values that moved between columns differ.

    Each side is read once.  Both are unioned and aggregated by the keys: per
    key and side a row count, null counts, and an order-insensitive
    fingerprint (the sum of a 64-bit hash of each whole row).  A second, global
    aggregation folds the per-key partials into the checks.  Partial
    aggregation collapses a hot key before the shuffle, and keys that repeat
    never produce row pairs, unlike a join on non-unique keys."""
    keys = list(keys)
    cols = [c for c in src.columns if c in tgt.columns]
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in cols}
    fp = F.xxhash64(*[x for c in cols for x in (F.col(quoted[c]).isNull(), F.col(quoted[c]))]).cast("decimal(38,0)")

    def side(df: DataFrame, tag: int) -> DataFrame:
        return df.select(*keys, F.lit(tag).alias("_side"), fp.alias("_fp"),
                         *[F.col(quoted[c]).isNull().cast("int").alias(f"_z{i}") for i, c in enumerate(cols)])

    s1, s2 = F.col("_side") == 1, F.col("_side") == 2
    per_key = side(src, 1).unionByName(side(tgt, 2)).groupBy(*keys).agg(
        F.count_if(s1).alias("ns"), F.count_if(s2).alias("nt"),
        F.sum(F.when(s1, F.col("_fp"))).alias("fs"), F.sum(F.when(s2, F.col("_fp"))).alias("ft"),
        *[F.sum(F.when(s1, F.col(f"_z{i}"))).alias(f"zs{i}") for i in range(len(cols))],
        *[F.sum(F.when(s2, F.col(f"_z{i}"))).alias(f"zt{i}") for i in range(len(cols))])
    total = per_key.agg(
        F.coalesce(F.sum("ns"), F.lit(0)).alias("rows_s"), F.coalesce(F.sum("nt"), F.lit(0)).alias("rows_t"),
        F.coalesce(F.sum(F.when(F.col("nt") == 0, F.col("ns"))), F.lit(0)).alias("only_s"),
        F.coalesce(F.sum(F.when(F.col("ns") == 0, F.col("nt"))), F.lit(0)).alias("only_t"),
        F.count_if((F.col("ns") > 0) & (F.col("nt") > 0)
                   & ((F.col("ns") != F.col("nt")) | (F.col("fs") != F.col("ft")))).alias("changed"),
        *[F.coalesce(F.sum(f"zs{i}"), F.lit(0)).alias(f"zs{i}") for i in range(len(cols))],
        *[F.coalesce(F.sum(f"zt{i}"), F.lit(0)).alias(f"zt{i}") for i in range(len(cols))])
    none = F.lit(0)
    checks = ([("row_count", "*", F.col("rows_s"), F.col("rows_t"))]
              + [("null_count", c, F.col(f"zs{i}"), F.col(f"zt{i}")) for i, c in enumerate(cols)]
              + [("only_in_source", "*", none, F.col("only_s")), ("only_in_replica", "*", none, F.col("only_t")),
                 ("changed", "*", none, F.col("changed"))])
    out = total.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("check_name"), F.lit(c).alias("column_name"), a.cast("bigint").alias("source_value"),
                 b.cast("bigint").alias("replica_value")) for k, c, a, b in checks])))
    # Types are schema metadata: one row per column, built on the driver.
    tt = dict(tgt.dtypes)
    types = src.sparkSession.createDataFrame(
        [("type_mismatch", c, 0, int(tt[c] != ty)) for c, ty in src.dtypes if c in tt]
        + [("missing_column", c, 1, 0) for c in src.columns if c not in tt]
        + [("missing_column", c, 0, 1) for c in tgt.columns if c not in src.columns],
        "check_name string, column_name string, source_value bigint, replica_value bigint")
    return out.unionByName(types).withColumn("ok", F.col("source_value") == F.col("replica_value"))


def reconcile_rows(src: DataFrame, tgt: DataFrame, keys: Sequence[str], bits: int = 12, levels: int = 2) -> DataFrame:
    """Y11, the rows themselves: what ``EXCEPT ALL`` gives both ways, with the side, the kind and the number of copies.

    ``side`` is source or replica; ``kind`` is ``missing`` if the other side has no row of that key, else ``changed``;
    ``copies`` is by how many the side has the row more often.  Both sides need the same columns.

    The keys' hashes span a tree of ``2**bits`` ranges per level.  Level by level, each side's rows of the ranges that
    still differ are aggregated to a count and two fingerprints per range (partial sums, so few narrow rows move),
    and the ranges that agree drop out; only rows of the last level's differing ranges are shuffled whole and compared.
    Where little differs, whole rows hardly move; where everything does, it costs ``levels`` scans more."""
    keys = list(keys)
    if sorted(src.columns) != sorted(tgt.columns):
        raise ValueError(f"columns differ: {sorted(set(src.columns) ^ set(tgt.columns))}")
    if levels < 1 or not 0 < bits * levels <= 63:
        raise ValueError("bits times levels is 1 to 63")
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in src.columns}
    parts = [x for c in src.columns for x in (F.col(quoted[c]).isNull(), F.col(quoted[c]))]
    place = F.xxhash64(F.lit("key"), *[F.col(quoted[k]) for k in keys])
    # Columns are read in one order on both sides, as a row's hash depends on it.
    both = (src.select(*quoted.values(), F.lit(1).alias("_side")).unionByName(tgt.select(*quoted.values(), F.lit(0).alias("_side")))
            .withColumn("_place", place))

    def ranged(level: int) -> Column:
        return F.shiftrightunsigned("_place", 64 - bits * level)

    sign = F.when(F.col("_side") == 1, 1).otherwise(-1)
    differing = None
    for level in range(1, levels + 1):
        rows = both if differing is None else both.withColumn("_above", ranged(level - 1)).join(differing, "_above", "left_semi")
        sums = rows.groupBy(ranged(level).alias("_range")).agg(
            F.sum(sign).alias("n"), F.sum(sign * F.xxhash64(*parts).cast("decimal(38,0)")).alias("a"),
            F.sum(sign * F.hash(*parts).cast("decimal(38,0)")).alias("b"))
        differing = sums.where("n <> 0 OR a <> 0 OR b <> 0").select(F.col("_range").alias("_above"))
    left = both.withColumn("_above", ranged(levels)).join(differing, "_above", "left_semi")
    one, two = F.col("_side") == 1, F.col("_side") == 0
    rows = left.groupBy(*quoted.values()).agg(F.count_if(one).alias("_s"), F.count_if(two).alias("_t")).where("_s <> _t")
    held = left.groupBy(*[F.col(quoted[k]).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.count_if(one).alias("_ks"), F.count_if(two).alias("_kt"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[quoted[k]].eqNullSafe(held[f"_k{i}"])
    more = F.col("_s") > F.col("_t")
    others = F.when(more, F.col("_kt")).otherwise(F.col("_ks"))
    return rows.join(held, same).select(
        *quoted.values(), F.when(more, "source").otherwise("replica").alias("side"),
        F.when(others == 0, "missing").otherwise("changed").alias("kind"), F.abs(F.col("_s") - F.col("_t")).alias("copies"))


def resume_plan(catalog: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active tables whose latest job is not completed (or that never ran),
    with that job's strategy and status and the last stored watermark."""
    latest = latest_per_key(
        jobs.select("table_id", "job_id", "strategy", "status", "started_at"),
        ["table_id"], [F.coalesce("started_at", F.lit("0001-01-01").cast("timestamp_ntz")), "job_id"])
    active = catalog.where(F.col("status") == "active").select("table_id", "schema_name", "table_name")
    plan = (active.join(latest.select("table_id", F.col("job_id").alias("last_job_id"),
                                      "strategy", F.col("status").alias("last_status")),
                        "table_id", "left")
            .where(F.col("last_status").isNull() | (F.col("last_status") != "completed")))
    return plan.join(last_watermark(jobs), "table_id", "left")


def committed_only(replica: DataFrame, jobs: DataFrame, batch_col: str = "batch",
                   job_col: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Rows written by completed jobs, and the rows a failed or unlogged
    run left behind.  Semi/anti joins on the batch column; when the batch is a
    partition column dynamic partition pruning skips the others."""
    done = jobs.select(F.col(job_col).alias("_b"))
    if "status" in jobs.columns:
        done = jobs.where(F.col("status") == "completed").select(F.col(job_col).alias("_b"))
    cond = F.col(batch_col) == F.col("_b")
    return replica.join(done, cond, "left_semi"), replica.join(done, cond, "left_anti")
