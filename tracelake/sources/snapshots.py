"""Snapshot files: one event for each new version of a file's bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.ids import content_hash
from tracelake.operators.store import Conflict
from tracelake.schema import EVENT, SCHEMA_VERSION, SOURCE


def read(spark: SparkSession, listing: DataFrame, paths: list[str]) -> DataFrame:
    """``listing`` with content and content_hash of the files at ``paths``."""
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("source_path"), F.col("content").alias("bytes"))
    return listing.join(files, "source_path").select(*listing.columns, F.decode("bytes", "UTF-8").alias("content"), content_hash(F.col("bytes")).alias("content_hash"))


def changed(found: DataFrame, latest: DataFrame) -> DataFrame:
    """Sources whose hash, root or kind isn't that of their latest stored snapshot; each source once."""
    old = latest.select(*SOURCE, F.struct("content_hash", "project_root", "artifact_kind").alias("_old"))
    own = found.dropDuplicates(SOURCE).join(old, SOURCE, "left")
    return own.where(~F.struct("content_hash", "project_root", "artifact_kind").eqNullSafe(F.col("_old"))).drop("_old")


def to_events(found: DataFrame, observed_at: str, next_seq: DataFrame | None = None) -> DataFrame:
    """One config_snapshot each: session ``snapshot``, no time of its own."""
    own = found if next_seq is None else found.join(next_seq, SOURCE, "left")
    seq = F.lit(0) if next_seq is None else F.coalesce("next_seq", F.lit(0))
    full = {f.name: F.lit(None).cast(f.dataType) for f in EVENT} | {c: F.col(c) for c in (*SOURCE, "content", "content_hash", "project_root", "artifact_kind")}
    full |= {"schema_version": F.lit(SCHEMA_VERSION), "source_session_id": F.lit("snapshot"), "seq": seq, "source_mode": F.lit("snapshot_file"), "event_type": F.lit("config_snapshot"), "actor": F.lit("system"), "time_confidence": F.lit("low"), "observed_at": F.lit(observed_at), "project_root_source": F.when(F.col("project_root").isNotNull(), "host_identity")}
    return own.select(*(full[f.name].cast(f.dataType).alias(f.name) for f in EVENT))


def sync(store, found: DataFrame, observed_at: str) -> dict[str, int]:
    """Append new versions; sources, changed, unchanged, appended, failed: changed ones that could not be stored."""
    from tracelake.operators.views import latest_snapshots

    latest = latest_snapshots(store.table("raw_events"))
    new = changed(found, latest)
    seqs = latest.select(*SOURCE, (F.col("seq") + 1).alias("next_seq"))
    n, m = found.select(*SOURCE).distinct().count(), new.count()
    out = {"sources": n, "changed": m, "unchanged": n - m, "appended": 0, "failed": 0}
    if not m:
        return out
    try:
        out["appended"] = store.append_events(to_events(new, observed_at, seqs)).agg(F.sum("appended")).first()[0]
    except Conflict:  # another writer was first; the next sync finds them changed again
        out["failed"] = m
    return out
