"""What is visible of the store, and the queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.schema import REVISIONS, SOURCE

#: Tombstone scopes and the event columns they name.
SCOPES = {"source_path": "source_path", "session": "source_session_id", "project_root": "project_root"}


def current(events: DataFrame, head: DataFrame) -> DataFrame:
    """Events of each source's head; a source without one is at (0, 0)."""
    h = head.select(*SOURCE, *(F.col(c).alias(f"_{c}") for c in REVISIONS))
    own = events.join(h, SOURCE, "left").where(" and ".join(f"{c} = coalesce(_{c}, 0)" for c in REVISIONS))
    return own.drop(*(f"_{c}" for c in REVISIONS))


def without_erased(events: DataFrame, tombstones: DataFrame, scopes: tuple[str, ...] = tuple(SCOPES)) -> DataFrame:
    """One anti join a scope: a single condition with OR would be a nested loop."""
    for scope in scopes:
        gone = tombstones.where(F.col("scope") == scope).select(F.col("key").alias("_key")).distinct()
        events = events.join(gone, F.col(SCOPES[scope]) == F.col("_key"), "left_anti")
    return events


def visible(events: DataFrame, head: DataFrame | None, tombstones: DataFrame | None) -> DataFrame:
    if head is not None:
        events = current(events, head)
    return events if tombstones is None else without_erased(events, tombstones)


def recent_sessions(seen: DataFrame, limit: int, since_ms: int | None = None) -> DataFrame:
    """Sessions by their last event's time, untimed ones last. ``since_ms`` also drops untimed events."""
    if since_ms is not None:
        seen = seen.where(F.col("occurred_at_unix_ms") >= since_ms)
    own = seen.groupBy(*SOURCE, "source_session_id").agg(F.max("occurred_at_unix_ms").alias("last_ms"), F.min("occurred_at_unix_ms").alias("first_ms"), F.count("*").alias("event_count"))
    return own.orderBy(F.desc_nulls_last("last_ms"), F.desc("source_path"), F.desc("source_session_id")).limit(limit)


def pull(seen: DataFrame, since: int = 0, limit: int = 1000) -> DataFrame:
    """A page of events by offset, broken rows included: :func:`whole` drops these, :func:`page_end` counts them."""
    return seen.where(F.col("offset") > since).orderBy("offset").limit(limit)


def whole(rows: DataFrame) -> DataFrame:
    """Rows whose content could be opened."""
    return rows.where("not broken").drop("broken")


def page_end(page: DataFrame) -> DataFrame:
    """max_scanned_offset of a page, broken rows included, so that a reader gets past them; null only for an empty page."""
    return page.agg(F.max("offset").alias("max_scanned_offset"))


def read_sessions(seen: DataFrame, specs: DataFrame, cap: int) -> DataFrame:
    """Events of listed sessions (source key, source_session_id, list_pos), in that order, ``cap`` at most."""
    return seen.join(specs, [*SOURCE, "source_session_id"]).orderBy("list_pos", "seq", "offset").limit(cap)


def read_session(events: DataFrame, head: DataFrame, source_type: str, location: str, path: str, session: str) -> DataFrame:
    """One session of one source's head, tombstones ignored."""
    own = events
    for c, value in zip((*SOURCE, "source_session_id"), (source_type, location, path, session), strict=True):
        own = own.where(F.col(c) == value)
    return current(own, head).orderBy("seq", "offset")


def skipped(session: DataFrame) -> int:
    """How many rows of a session could not be opened."""
    return session.where("broken").count()


def latest_snapshots(events: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """The last snapshot of each source by offset, whatever the head says."""
    own = events.where("event_type = 'config_snapshot'")
    if tombstones is not None:
        own = without_erased(own, tombstones, ("source_path", "project_root"))
    best = W.partitionBy(*SOURCE).orderBy(F.desc("offset"))
    return own.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def active_snapshots(latest: DataFrame, probes: DataFrame) -> DataFrame:
    """Snapshots whose file is there or could not be asked for. probes: source_path, status."""
    return latest.join(probes.select("source_path", "status"), "source_path", "left").where("coalesce(status, 'unknown') in ('file', 'unknown')").drop("status")


def present_snapshots(latest: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """Snapshots whose files a location's own listing holds. A location whose question failed, or that wasn't asked, keeps all.

    asked: source_location, answered. found: source_location, source_path.
    """
    told = asked.groupBy("source_location").agg(F.bool_and("answered").alias("_told"))
    there = found.select("source_location", "source_path", F.lit(True).alias("_there")).distinct()
    own = latest.join(told, "source_location", "left").join(there, ["source_location", "source_path"], "left")
    return own.where(~F.coalesce("_told", F.lit(False)) | F.coalesce("_there", F.lit(False))).select(latest.columns)


def changes(log: DataFrame, since: int = 0, limit: int = 1000) -> DataFrame:
    return log.where(F.col("seq") > since).orderBy("seq").limit(limit)


def status(events: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    own = events.agg(F.count("*").alias("events"), F.coalesce(F.max("offset"), F.lit(0)).alias("max_offset"), F.max("ingested_at").alias("last_ingested"))
    return own if keys is None else own.crossJoin(keys.agg(F.count("*").alias("data_keys")))  # one row each


def gc_candidates(projections: DataFrame, head: DataFrame, events: DataFrame | None = None, *, strict_reference: bool = False) -> DataFrame:
    """Superseded reparses and their events, counted in ``events`` or else as the ledger has them.

    By default only those of the head's source revision: an earlier one may be the only copy of bytes that are gone.
    """
    h = head.select(*SOURCE, F.struct(*REVISIONS).alias("_head"))
    own = projections.where("origin = 'reparse'").join(h, SOURCE, "left").where(~F.struct(*REVISIONS).eqNullSafe(F.col("_head")))
    if not strict_reference:
        own = own.where("source_revision = _head.source_revision")
    if events is None:
        return own.select(*SOURCE, *REVISIONS, "events")
    counts = events.groupBy(*SOURCE, *REVISIONS).agg(F.count("*").alias("events"))
    return own.select(*SOURCE, *REVISIONS).join(counts, [*SOURCE, *REVISIONS], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def ledger_of(events: DataFrame) -> DataFrame:
    """The ledger that events themselves tell: origin ``unknown``, created when first ingested."""
    own = events.groupBy(*SOURCE, *REVISIONS).agg(F.coalesce(F.min("ingested_at"), F.lit(0)).alias("created_at"), F.count("*").alias("events"))
    return own.withColumns({"origin": F.lit("unknown"), "token": F.lit(None).cast("string")})


def heads_of(ledger: DataFrame) -> DataFrame:
    """Each source's highest revisions, chosen among its projections rather than its events."""
    top = ledger.groupBy(*SOURCE).agg(F.max(F.struct(*REVISIONS)).alias("_top"))
    return top.select(*SOURCE, *(F.col(f"_top.{c}").alias(c) for c in REVISIONS))


def distinct_roots(events: DataFrame) -> DataFrame:
    """The project roots that events name, blank ones left out."""
    return events.where("project_root <> ''").select("project_root").distinct()


def root_report(registry: DataFrame, identities: DataFrame, probes: DataFrame) -> DataFrame:
    """Roots with their latest identity and the last probe's verdict, looked up by the path's key or else the stored one."""
    from tracelake.functions.ids import verdict
    from tracelake.functions.paths import aliases, project_dirs, registry_key

    best = identities.groupBy(F.col("project_root").alias("_k")).agg(F.max_by("canonical_id", F.struct("last_seen_ms", "id")).alias("_id"))
    asked = probes.groupBy(F.col("project_root").alias("_k")).agg(F.max_by("outcome", "last_probe_ms").alias("_out"))
    own = registry.withColumn("_path_key", registry_key(F.col("root_path")))
    for k, (table, value) in enumerate(((best, "_id"), (asked, "_out"))):
        for name, key in (("a", "_path_key"), ("b", "root_key")):
            t = table.select(F.col("_k").alias(f"_k{k}{name}"), F.col(value).alias(f"{value}{name}"))
            own = own.join(t, F.col(key) == F.col(f"_k{k}{name}"), "left")
    own = own.withColumn("aliases", aliases(F.col("root_path")))
    return own.select("root_key", "root_path", "root_source", F.coalesce("_ida", "_idb").alias("canonical_id"), F.coalesce(verdict(F.coalesce("_outa", "_outb")), F.lit("not_probed")).alias("verdict"), "aliases", project_dirs(F.col("root_path"), F.col("aliases")).alias("project_dirs"))


def merge_identities(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_root", "canonical_id").agg(F.min("first_seen_ms").alias("first_seen_ms"), F.max("last_seen_ms").alias("last_seen_ms"))
