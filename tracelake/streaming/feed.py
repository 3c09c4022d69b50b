"""A copy of the store's visible events that follows its change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import views
from tracelake.operators.store import Store
from tracelake.schema import SOURCE


def replaced(copy: DataFrame, changed: DataFrame, now: DataFrame) -> DataFrame:
    """``copy`` with each source in ``changed`` taken out whole and put in again as it is ``now``.

    Rows can't be merged one by one: those that the new projection no longer has would stay.
    """
    some = changed.select(*SOURCE).distinct()
    return copy.join(some, SOURCE, "left_anti").select(*copy.columns).unionByName(now.join(some, SOURCE, "left_semi").select(*copy.columns))


def follow(store: Store, copy: DataFrame, *, after_seq: int, after_offset: int) -> tuple[DataFrame, int, int]:
    """``copy`` brought up to date, and the positions to go on from: the feed's seq and the events' offset.

    Sources whose head moved are replaced whole; of others the events after ``after_offset`` are added. What
    was erased since goes, whether or not the feed tells of it. The copy has raw_events' columns.
    """
    log = views.changes(store.table("projection_log"), after_seq, (1 << 31) - 1)
    now = views.whole(store.visible())
    out = replaced(copy, log, now)
    added = now.where(F.col("offset") > after_offset).join(log.select(*SOURCE).distinct(), SOURCE, "left_anti")
    out = views.without_erased(out.unionByName(added.select(*copy.columns)), store.table("tombstones")).select(*copy.columns)
    seq = log.agg(F.max("seq")).first()[0]
    return out, after_seq if seq is None else seq, max(after_offset, store.manifest().get("top", 0))
