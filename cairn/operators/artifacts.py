"""Artifact management (A1-A11): stored result files with owner, tags,
metadata and a sliding expiry, as DataFrame rewrites of the artifact and tag
tables.  ``now`` is a parameter; every owner check is a join condition, so an
operation on someone else's artifact is a no-op, never an error path in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.core import base64_size, base64_valid, days, ts_lit
from cairn.operators.catalog import tag_lists

# Enumerations, limits and media types of the reference.
ARTIFACT_TYPES = ["data", "model", "report", "other"]
ARTIFACT_FORMATS = ["json", "csv", "parquet", "pickle", "text", "binary"]
MAX_SIZE_MB = 50
DEFAULT_EXPIRY_DAYS = 10
CONTENT_TYPES = {
    "json": "application/json",
    "csv": "text/csv",
    "parquet": "application/octet-stream",
    "pickle": "application/octet-stream",
    "text": "text/plain",
    "binary": "application/octet-stream",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"

def ingest(uploads: DataFrame, now: str, max_mb: int = MAX_SIZE_MB,
           default_days: int = DEFAULT_EXPIRY_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A1: validate and accept a batch of uploads; returns the accepted
    artifacts, their tag rows and the rejected uploads with the reason.

    Checked in the order of the request model, then the content: name of 1 to
    255 characters, type and format within their enumerations, expiry days
    above 0 when given, strict base64 (D12), size up to ``max_mb``.  Accepted
    rows get size, created_at = now and expires_at = now + days (default 10),
    and keep their ``metadata`` (JSON text, default ``{}``) and ``tags`` (array),
    if the uploads have these columns."""
    # Validity and size come from the text alone (alphabet, padding, length),
    # so whole contents are decoded once, only for the accepted rows.
    text = F.col("content")
    valid = base64_valid(text)
    size = base64_size(text)
    reason = (F.when(F.col("name").isNull() | (F.length("name") < 1) | (F.length("name") > 255),
                     "invalid name")
              .when(~F.col("type").isin(ARTIFACT_TYPES) | F.col("type").isNull(), "invalid type")
              .when(~F.col("format").isin(ARTIFACT_FORMATS) | F.col("format").isNull(), "invalid format")
              .when(F.col("expiry_days") <= 0, "invalid expiry_days")
              .when(~F.coalesce(valid, F.lit(False)), "invalid base64")
              .when(size > F.lit(max_mb * 1024 * 1024), "too large"))
    meta = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in uploads.columns else F.lit("{}")
    checked = uploads.withColumn("_reason", reason)
    t = ts_lit(now)
    artifact_id = F.concat(F.lit("a"), F.lpad(F.col("upload_id").cast("string"), 8, "0"))
    accepted = checked.where(F.col("_reason").isNull()).select(
        artifact_id.alias("artifact_id"), "name", "type", "format",
        size.alias("size_bytes"),
        F.concat(F.lit("artifacts/"), artifact_id, F.lit("."), F.col("format")).alias("storage_path"),
        t.alias("created_at"),
        (t + days(F.coalesce(F.col("expiry_days"), F.lit(default_days)))).alias("expires_at"),
        meta.alias("metadata"), "swarm_token", F.unbase64(text).alias("content"))
    given = F.col("tags") if "tags" in uploads.columns else F.array().cast("array<string>")
    tags = checked.where(F.col("_reason").isNull()).select(
        artifact_id.alias("artifact_id"), F.explode(F.array_distinct(given)).alias("tag"))
    rejected = checked.where(F.col("_reason").isNotNull()).select("upload_id", F.col("_reason").alias("reason"))
    return accepted, tags, rejected


def artifact_info(artifacts: DataFrame, tags: DataFrame, owner: str | None = None) -> DataFrame:
    """A2: artifacts with their tag list (empty when none) and parsed metadata,
    for one owner (all owners when ``owner`` is None)."""
    a = artifacts if owner is None else artifacts.where(F.col("swarm_token") == owner)
    return (a.join(tag_lists(tags, "artifact_id"), "artifact_id", "left")
            .select("artifact_id", "name", "type", "format", "size_bytes", "created_at",
                    "expires_at", "swarm_token",
                    F.from_json("metadata", "map<string,string>").alias("metadata"),
                    F.coalesce("tags", F.array().cast("array<string>")).alias("tags")))


def with_all_tags(artifacts: DataFrame, tags: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """A4: only artifacts carrying every one of the wanted tags."""
    wanted = sorted(set(wanted))
    if not wanted:
        return artifacts
    hits = (tags.where(F.col("tag").isin(wanted)).groupBy("artifact_id")
            .agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(wanted)))
    return artifacts.join(hits.select("artifact_id"), "artifact_id", "left_semi")


def list_artifacts(artifacts: DataFrame, tags: DataFrame, owner: str, type: str | None = None,
                   format: str | None = None, created_after: str | None = None,
                   created_before: str | None = None, min_size: int | None = None,
                   max_size: int | None = None, tags_all: Sequence[str] | None = None) -> DataFrame:
    """A3: an owner's artifacts under optional filters (bounds inclusive; a
    bound of 0 is applied, D14), newest first."""
    a = artifacts.where(F.col("swarm_token") == owner)
    if type is not None:
        a = a.where(F.col("type") == type)
    if format is not None:
        a = a.where(F.col("format") == format)
    if created_after is not None:
        a = a.where(F.col("created_at") >= ts_lit(created_after))
    if created_before is not None:
        a = a.where(F.col("created_at") <= ts_lit(created_before))
    if min_size is not None:
        a = a.where(F.col("size_bytes") >= min_size)
    if max_size is not None:
        a = a.where(F.col("size_bytes") <= max_size)
    if tags_all:
        a = with_all_tags(a, tags, tags_all)
    return artifact_info(a, tags).orderBy(F.col("created_at").desc(), "artifact_id")


def _owned(patches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Patches whose owner matches the artifact's owner."""
    owners = artifacts.select("artifact_id", F.col("swarm_token").alias("_owner"))
    return (patches.join(owners, "artifact_id", "inner")
            .where(F.col("swarm_token") == F.col("_owner")).drop("_owner"))


def _in_order(patches: DataFrame, artifacts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per artifact: what its owner's valid patches give, applied one
    after another (``patch_seq``; without that column in the order of the
    rows' values): the last value that isn't null, per field.

    A patch with ``expiry_days`` of 0 or less is invalid as a whole."""
    p = _owned(patches, artifacts)
    if "expiry_days" in p.columns:
        p = p.where(F.col("expiry_days").isNull() | (F.col("expiry_days") > 0))
    order = F.col("patch_seq") if "patch_seq" in p.columns else F.struct(
        *[c for c in ("name", "metadata", "expiry_days", "tags") if c in p.columns])
    return p.groupBy("artifact_id").agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f"_{f}") for f in fields])


def update(artifacts: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """A5: patch name, metadata and expiry; a null field keeps the old value,
    a given expiry counts from ``now``; only the owner's valid patches apply,
    several patches of one artifact in their order."""
    p = _in_order(patches, artifacts, ["name", "metadata", "expiry_days"])
    t = ts_lit(now)
    out = artifacts.join(p, "artifact_id", "left")
    return out.select(*[
        F.coalesce("_name", "name").alias("name") if c == "name" else
        F.coalesce("_metadata", "metadata").alias("metadata") if c == "metadata" else
        F.when(F.col("_expiry_days").isNotNull(), t + days(F.col("_expiry_days"))).otherwise(F.col("expires_at"))
         .alias("expires_at") if c == "expires_at" else F.col(c)
        for c in artifacts.columns])


def replace_tags(tags: DataFrame, patches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A given tag list replaces all old tags (an empty list clears them);
    a null list leaves them; only the owner's valid patches apply, and of
    several lists the last."""
    p = _in_order(patches, artifacts, ["tags"]).where(F.col("_tags").isNotNull())
    kept = tags.join(p.select("artifact_id"), "artifact_id", "left_anti")
    new = p.select("artifact_id", F.explode(F.array_distinct("_tags")).alias("tag"))
    return kept.unionByName(new)


def delete(artifacts: DataFrame, tags: DataFrame, requests: DataFrame
           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete the requested artifacts of their owners with their tags.
    Returns the remaining artifacts, the remaining tags and the deleted
    (artifact_id, storage_path) rows whose files the caller unlinks."""
    doomed = (_owned(requests.select("artifact_id", "swarm_token"), artifacts)
              .select("artifact_id").distinct())
    deleted = artifacts.join(doomed, "artifact_id", "left_semi").select("artifact_id", "storage_path")
    return (artifacts.join(doomed, "artifact_id", "left_anti"),
            tags.join(doomed, "artifact_id", "left_anti"), deleted)


def touch(artifacts: DataFrame, accesses: DataFrame, extend_days: int = DEFAULT_EXPIRY_DAYS) -> DataFrame:
    """Reading content moves expires_at to the last access + 10 days; it
    never shortens a longer expiry (D13).  Only the owner (``swarm_token``) can
    read content, so an access by anyone else moves nothing."""
    last = accesses.groupBy("artifact_id", "swarm_token").agg(F.max("accessed_at").alias("_last"))
    out = artifacts.join(last, ["artifact_id", "swarm_token"], "left")
    new_exp = F.when(F.col("_last").isNull(), F.col("expires_at")).otherwise(
        F.greatest(F.col("expires_at"), F.col("_last") + days(extend_days)))
    return out.select(*[new_exp.alias(c) if c == "expires_at" else F.col(c) for c in artifacts.columns])


def purge(artifacts: DataFrame, tags: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split into live and expired (expires_at < now).  Returns live
    artifacts, their tags, and the expired rows whose files the caller removes."""
    expired_flag = F.col("expires_at") < ts_lit(now)
    expired = artifacts.where(expired_flag)
    live = artifacts.where(~expired_flag | F.col("expires_at").isNull())
    live_tags = tags.join(expired.select("artifact_id"), "artifact_id", "left_anti")
    return live, live_tags, expired


def content_type(artifacts: DataFrame) -> DataFrame:
    """A10: media type by format (octet-stream for anything else)."""
    m = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return artifacts.select("artifact_id", "format",
                            F.coalesce(F.element_at(m, F.col("format")), F.lit(DEFAULT_CONTENT_TYPE))
                             .alias("content_type"))


def extend(artifacts: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """Extend by hand: expires_at becomes now + the given days unless it
    is already later; only the owner's requests apply."""
    r = (_owned(requests.select("artifact_id", "swarm_token", "expiry_days"), artifacts)
         .where(F.col("expiry_days") > 0)
         .groupBy("artifact_id").agg(F.max("expiry_days").alias("_days")))
    out = artifacts.join(r, "artifact_id", "left")
    new_exp = F.when(F.col("_days").isNull(), F.col("expires_at")).otherwise(
        F.greatest(F.col("expires_at"), ts_lit(now) + days(F.col("_days"))))
    return out.select(*[new_exp.alias(c) if c == "expires_at" else F.col(c) for c in artifacts.columns])
