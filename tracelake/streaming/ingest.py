"""Transcripts as a stream: growing files through the parsers into the store, one commit a micro-batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions.ids import projection_token
from tracelake.operators.parse import end_state
from tracelake.operators.parse import events as parse_events
from tracelake.operators.store import Store
from tracelake.schema import LINE, PARSER_REVISION, SOURCE, STATE
from tracelake.sources.growing_log import GrowingLog


def commit(store: Store, batch: DataFrame, registry: DataFrame, **options) -> DataFrame:
    """Commit new lines (LINE schema with byte_end and control): rolled back files replace, others append.

    The parsers go on from the state that the last commit of a file stored, so only new lines are parsed.
    Lines before that state's end were committed already, by a batch that is played again, and are dropped. A
    file whose lines begin after it, because its state is unknown or gone, is read anew from its start;
    events that are stored are then found by their sequence numbers. The token of a rollback takes the hash
    of the new bytes, so that one played again changes nothing and another of equal length does.
    """
    with store.staging() as stage:
        batch = stage(batch)
        rolled = F.col("control") == "rollback"
        seen = stage(batch.groupBy(*SOURCE).agg(F.count_if(rolled).alias("_r"), F.max(F.when(rolled, F.col("line"))).alias("_hash"), F.min("byte_start").alias("_start"), F.max("byte_end").alias("end_byte")))
        fresh = seen.where("_r > 0").select(*SOURCE)
        state = stage(store.parser_state().select(*STATE.names).join(seen, SOURCE, "left_semi").join(fresh, SOURCE, "left_anti"))
        gaps = seen.where("_r = 0").join(state.select(*SOURCE, F.col("end_byte").alias("_known")), SOURCE, "left").where("_start > coalesce(_known, 0)")
        state = state.join(gaps, SOURCE, "left_anti")
        body = batch.where("control is null").select(*LINE.names, "byte_end")
        own = body.join(gaps, SOURCE, "left_anti").unionByName(_from_start(store.spark, stage(gaps)))
        own = own.join(state.select(*SOURCE, F.col("end_byte").alias("_done")), SOURCE, "left").where("byte_start >= coalesce(_done, 0)").select(*LINE.names)
        known = projection_token(*(F.col(c) for c in (*SOURCE, "_hash")), F.lit(PARSER_REVISION), F.lit(store.attribution_revision()), F.lit(0), F.col("end_byte"))
        sources = seen.select(*SOURCE, F.when(F.col("_r") > 0, "rollback").otherwise("append").alias("reason"), F.when(F.col("_r") > 0, known).alias("token"))
        made = parse_events(own, registry, state=state, stage=stage, **options)
        return store.apply_projection(sources, made, state=lambda done: end_state(own, seen, state, done))


def _from_start(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """All lines of files up to ``end_byte``."""
    names = [r["source_path"] for r in sources.select("source_path").distinct().collect()]  # of files whose state is gone
    if not names:
        return spark.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LINE) + ", byte_end long")
    spark.dataSource.register(GrowingLog)
    lines = spark.read.format("growing_log").option("paths", json.dumps(sorted(names))).load()
    return lines.join(sources.select(*SOURCE, "end_byte"), "source_path").where("byte_start < end_byte").select(*LINE.names, "byte_end")


def start(spark: SparkSession, store: Store, folder: str, checkpoint: str, *, source_type: str, registry: DataFrame, **trigger) -> StreamingQuery:
    """A query that commits each micro-batch's lines. Late events are welcome: there is no watermark.

    Lines that aren't JSON are passed over: unlike a scan, a stream can't hold its offset for one file.
    """
    spark.dataSource.register(GrowingLog)
    stream = spark.readStream.format("growing_log").option("path", folder).load()

    def each(batch: DataFrame, _: int) -> None:
        own = batch.select(F.lit(source_type).alias("source_type"), F.lit("local").alias("source_location"), "*")
        if not own.isEmpty():
            commit(store, own, registry)

    out = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
