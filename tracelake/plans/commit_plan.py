"""What a scan may write: five decisions from an observation, as one pure expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decisions(*, quality: Column, events: Column, rewritten: Column, stale: Column, full_reason: Column, prior: Column) -> Column:
    """struct(index, store, cursor, sync, quality).

    quality: clean, degraded, poison_line or unavailable. stale: parser or attribution are out of date.
    full_reason: initial, forced or sync debt. prior: whether a projection is there.
    """
    made = lambda index, store, held, quality: F.struct(F.lit(index).alias("index"), F.lit(store).alias("store"), F.lit("freeze" if held else "advance").alias("cursor"), F.lit("hold" if held else "advance").alias("sync"), quality.alias("quality"))
    full = rewritten | stale | full_reason | (quality == "degraded")
    return (
        F.when((quality == "degraded") & (events == 0), made("preserve", "preserve", True, F.lit("degraded")))
        .when(quality == "unavailable", made("preserve", "preserve", True, F.lit("unknown")))
        .when(quality == "poison_line", made("preserve", "preserve", True, F.lit("poison_line")))
        .when(rewritten & prior, made("replace_file", "rollback", False, quality))
        .when(stale & prior, made("replace_file", "reparse", False, quality))
        .when(full, made("replace_file", "append", False, quality))
        .otherwise(made("append_facts", "append", False, F.lit("clean")))
    )


def events_are_usable(quality: Column) -> Column:
    """Good lines of a degraded read count; a poison line takes its whole batch with it."""
    return quality.isin("clean", "degraded")


def should_record(quality: Column, failed_at: Column) -> Column:
    """Whether a pass over a file leaves a trace: all but one that couldn't even be asked for (failed_at ``stat``)."""
    return ~F.coalesce((quality == "unavailable") & (failed_at == "stat"), F.lit(False))


def owes_reprojection(known: Column, now: Column) -> Column:
    """A recorded revision that differs; one never recorded isn't stale."""
    return known.isNotNull() & (known != now)


def plan(observations: DataFrame) -> DataFrame:
    """``observations`` with the five decisions as columns."""
    names = ("quality", "events", "rewritten", "stale", "full_reason", "prior")
    out = observations.withColumn("_d", decisions(**{n: F.col(n) for n in names}))
    return out.select("*", *(F.col(f"_d.{n}").alias(f"plan_{n}") for n in ("index", "store", "cursor", "sync", "quality"))).drop("_d")
