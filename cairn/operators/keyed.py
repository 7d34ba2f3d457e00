"""Upserts that write what changed (Y3): a replica in key buckets, merged on read.

``KeyedReplica`` deals rows to ``buckets`` by a hash of their keys.  Each batch is a folder with one
subfolder per bucket; every row has a number in its batch.  An upsert writes the delta's winning rows and
the (batch, row number) of the rows they replace, nothing else; a reader leaves the replaced rows out by an
anti join, whose smaller side Spark broadcasts if it is small at run time.  ``compact_buckets`` rewrites the
buckets where replaced rows or batches have piled up, and only those; from then on readers skip these
buckets in older batches.

An upsert of a few keys reads the key columns of the buckets its keys fall into, joined with the (aggregated)
delta; it writes in proportion to the delta.  The log is that of ``Replica``: commits are atomic, jobs that lose start
again, a half-written batch is invisible.  What comes to the driver is a number per bucket and batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.core import latest_per_key
from cairn.operators.sync import ATTEMPTS, Replica, Snapshot

#: Columns that a stored row has besides its own.
BUCKET, ROW = "_bucket", "_rid"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class KeyedReplica(Replica):
    """A replica whose rows are replaced by key.  ``keys`` and ``buckets`` are fixed when it is first written."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], table_name: str = "table", buckets: int = 64):
        super().__init__(spark, root, table_name)
        self.keys, self.buckets = list(keys), buckets
        layout = {"keys": self.keys, "buckets": buckets}
        have = next((e["layout"] for e in self.commits.entries() if e.get("layout")), layout)
        if have["keys"] != self.keys:
            raise ValueError(f"the replica's keys are {have['keys']}")
        self.buckets, self.layout = have["buckets"], {"keys": self.keys, "buckets": have["buckets"]}

    # -- reading -------------------------------------------------------------
    def _replaced(self, snapshot: Snapshot) -> dict[int, set[int]]:
        """Per batch (its entry's number) the buckets that a later entry has rewritten."""
        out: dict[int, set[int]] = {}
        later: set[int] = set()
        for e in reversed(snapshot.batches()):
            out[e["seq"]] = set(later)
            later |= set(e.get("rewrote") or ())
        return out

    def _stored(self, snapshot: Snapshot, only: set[int] | None = None) -> DataFrame | None:
        """Live rows with their place (``_bucket``, ``_batch``, ``_rid``), of some buckets if ``only`` is given."""
        fields = snapshot.schema().fields
        replaced = self._replaced(snapshot)
        rows, gone = [], []
        for e in snapshot.batches():
            live = set(range(self.buckets)) - replaced[e["seq"]]
            if only is not None:
                live &= only
            mine = {int(b) for b in e["stats"]["rows"]} & live
            if mine:
                own = {f.name for f in T.StructType.fromJson(json.loads(e["schema_json"])).fields}
                schema = T.StructType([f for f in fields if f.name in own] + [T.StructField(ROW, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
                rows.append(self.spark.read.schema(schema).parquet(f"{self.data_path}/{e['folder']}/rows").where(F.col(BUCKET).isin(sorted(mine)))
                            .select(*[F.col(_q(f.name)) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in fields],
                                    BUCKET, F.lit(e["seq"]).cast("bigint").alias("_batch"), ROW))
            theirs = {int(b) for b in e["stats"]["deleted"]} & live
            if theirs:
                gone.append(self.spark.read.schema(f"_batch bigint, {ROW} bigint, {BUCKET} int")
                            .parquet(f"{self.data_path}/{e['folder']}/deletes").where(F.col(BUCKET).isin(sorted(theirs))))
        if not rows:
            return None
        out = reduce(DataFrame.unionByName, rows)
        return out.join(reduce(DataFrame.unionByName, gone), [BUCKET, "_batch", ROW], "left_anti") if gone else out

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The live rows.  Before the first batch it is empty and has no columns."""
        snapshot = snapshot or self.snapshot()
        stored = self._stored(snapshot)
        if stored is None:
            return self.spark.createDataFrame([], snapshot.schema())
        return stored.select(*[_q(f.name) for f in snapshot.schema().fields])

    def needed(self, snapshot: Snapshot) -> set[str]:
        """A batch all of whose buckets were rewritten isn't opened any more."""
        replaced = self._replaced(snapshot)
        return {e["folder"] for e in snapshot.batches()
                if {int(b) for part in e["stats"].values() for b in part} - replaced[e["seq"]]}

    # -- writing -------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(_q(k)) for k in self.keys]), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _store(self, snapshot: Snapshot, job_id: str, strategy: str, rows: DataFrame, deletes: DataFrame | None,
               watermark_col: str | None = None, rewrote: set[int] | None = None, depends: bool = True) -> dict | None:
        """Write rows (with ``_bucket``) and deletes, and commit them; None if the job must start again."""
        folder = f"job={quote(job_id, safe='')}-{uuid.uuid4().hex[:12]}"
        path = f"{self.data_path}/{folder}"
        schema = T.StructType([f for f in rows.schema.fields if f.name != BUCKET])
        entry = {"job_id": job_id, "table_name": self.table_name, "strategy": strategy, "status": "failed", "rows_processed": 0,
                 "total_rows": 0, "last_value": None, "error_message": None, "folder": folder, "schema_json": schema.json(),
                 "violations": None, "layout": self.layout, "rewrote": sorted(rewrote) if rewrote else None, "stats": None}
        try:
            self._check_schema(snapshot, schema, strategy)
            # One task for a bucket, small buckets together, large ones split.
            (rows.hint("rebalance", BUCKET).withColumn(ROW, F.monotonically_increasing_id())
                 .write.partitionBy(BUCKET).parquet(f"{path}/rows"))
            if deletes is not None:
                deletes.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/deletes")
            stats = {"rows": self._per_bucket(f"{path}/rows", f"{ROW} bigint"),
                     "deleted": self._per_bucket(f"{path}/deletes", f"_batch bigint, {ROW} bigint") if deletes is not None else {}}
            if watermark_col:
                written = self.spark.read.schema(schema).parquet(f"{path}/rows")
                entry["last_value"] = written.agg(F.max(_q(watermark_col)).cast("string").alias("w")).first()["w"]
        except Exception as exc:
            entry["error_message"] = str(exc)
            self._commit(snapshot, entry, False)
            raise
        n = sum(stats["rows"].values())
        entry.update(status="completed", rows_processed=n, total_rows=n, stats=stats, deleted=sum(stats["deleted"].values()))
        return self._commit(snapshot, entry, depends)

    def _per_bucket(self, path: str, schema: str) -> dict[str, int]:
        """Rows per bucket of written files (counted from their footers and folder names)."""
        counted = self.spark.read.schema(f"{schema}, {BUCKET} int").parquet(path).groupBy(BUCKET).count().collect()
        return {str(r[BUCKET]): r["count"] for r in counted}

    def load(self, src: DataFrame, job_id: str, watermark_col: str | None = None) -> dict:
        """Replace the whole replica by ``src``."""
        return self._until(job_id, lambda seen: self._store(seen, job_id, "full", src.select("*", self._bucket()), None, watermark_col, depends=False))

    def _until(self, job_id: str, attempt) -> dict:
        for _ in range(ATTEMPTS):
            seen = self.snapshot()
            if done := seen.completed(job_id):
                return done
            if entry := attempt(seen):
                return entry
        raise RuntimeError(f"job {job_id} lost to other jobs {ATTEMPTS} times")

    def upsert(self, delta: DataFrame, job_id: str, version_col: str | None = None, watermark_col: str | None = None) -> dict:
        """One row per key of the delta, by the rules of ``sync.upsert``: the greatest version (then the greatest row) of the delta; a
        live row with a greater version stays and the delta's row for that key is dropped, otherwise it replaces all live rows of its key."""
        def attempt(seen: Snapshot) -> dict | None:
            known = [f.name for f in seen.schema().fields]
            cols = delta.columns if not known or version_col in known or version_col is None else [c for c in delta.columns if c != version_col]
            ver = [F.col(_q(version_col)).alias("_ver")] if version_col else []
            rest = F.struct(*[F.col(_q(c)) for c in cols if c not in self.keys] or [F.lit(0).alias("_")])
            latest = latest_per_key(delta.select(*[_q(c) for c in cols], *ver), self.keys, ["_ver", rest] if ver else [rest])
            # The delta is read once: what is replaced and what is written come from the same rows.
            latest.withColumn(BUCKET, self._bucket()).write.parquet(staged)
            latest = self.spark.read.parquet(staged)
            touched = {r[BUCKET] for r in latest.select(BUCKET).distinct().collect()}
            stored = self._stored(seen, touched)
            winners = latest.drop("_ver")
            if stored is None:
                return self._store(seen, job_id, "delta", winners, None, watermark_col)
            versioned = version_col is not None and version_col in known
            at = [F.col(_q(k)).alias(f"_k{i}") for i, k in enumerate(self.keys)]
            held = stored.select(*at, BUCKET, "_batch", ROW, *([F.col(_q(version_col)).alias("_have")] if versioned else []))
            new = latest.select(*at, BUCKET, *(["_ver"] if versioned else []))
            same = held[BUCKET] == new[BUCKET]
            for i in range(len(self.keys)):
                same = same & held[f"_k{i}"].eqNullSafe(new[f"_k{i}"])
            if versioned:
                newer = F.coalesce(held["_have"] > new["_ver"], held["_have"].isNotNull() & new["_ver"].isNull())
                keeps = held.join(new, same & newer, "left_semi").select(*[F.col(f"_k{i}").alias(f"_h{i}") for i in range(len(self.keys))], F.col(BUCKET).alias("_hb"))
                beaten = winners[BUCKET] == keeps["_hb"]
                for i, k in enumerate(self.keys):
                    beaten = beaten & winners[_q(k)].eqNullSafe(keeps[f"_h{i}"])
                winners = winners.join(keeps, beaten, "left_anti")
                same = same & ~newer
            deletes = held.join(new, same, "left_semi").select(BUCKET, "_batch", ROW)
            return self._store(seen, job_id, "delta", winners, deletes, watermark_col)

        def staged_attempt(seen: Snapshot) -> dict | None:
            nonlocal staged
            staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
            try:
                return attempt(seen)
            finally:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

        staged = ""
        return self._until(job_id, staged_attempt)

    def load_of_buckets(self, snapshot: Snapshot) -> dict[int, tuple[int, int, int]]:
        """Per bucket: rows stored, of them replaced, batches that hold some."""
        replaced = self._replaced(snapshot)
        out: dict[int, list[int]] = {}
        for e in snapshot.batches():
            for i, part in enumerate(("rows", "deleted")):
                for b, n in e["stats"][part].items():
                    if int(b) not in replaced[e["seq"]]:
                        mine = out.setdefault(int(b), [0, 0, 0])
                        mine[i] += n
                        mine[2] += i == 0
        return {b: tuple(v) for b, v in out.items()}

    def compact_buckets(self, job_id: str, most_replaced: float = 0.2, most_batches: int = 8) -> dict | None:
        """Rewrite the buckets in which more than a share of the stored rows are replaced or that lie in more
        batches than that.  None if there are none."""
        def attempt(seen: Snapshot) -> dict | None:
            due = {b for b, (rows, gone, batches) in self.load_of_buckets(seen).items() if gone > most_replaced * rows or batches > most_batches}
            if not due:
                return {"job_id": job_id, "status": "completed", "rewrote": [], "rows_processed": 0}
            rows = self._stored(seen, due).drop("_batch", ROW)
            return self._store(seen, job_id, "rebucket", rows, None, rewrote=due)

        entry = self._until(job_id, attempt)
        return entry if entry["rewrote"] else None
