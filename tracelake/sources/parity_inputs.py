"""The two sides of a parity run, as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators.parity import ADVISORY, BUCKET, MUST, facts
from tracelake.schema import EVENT

_NUMBERS = {"seq", *(c for c in MUST if c.endswith("_tokens"))}
FACT = T.StructType([T.StructField(c, T.LongType() if c in _NUMBERS else T.StringType()) for c in (*BUCKET, "seq", *MUST, *ADVISORY)])


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines without a byte order mark, blank ones left out."""
    own = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"))
    return own.where(F.col("line").rlike(r"\S"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Facts, one a line. A line that isn't one fails the run."""
    return _rows(spark, path).select(F.from_json("line", FACT, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def emitted(spark: SparkSession, path: str) -> DataFrame:
    """Usage facts among emitted rows (kind, event). Other kinds and broken lines are passed over."""
    row = T.StructType([T.StructField("kind", T.StringType()), T.StructField("event", EVENT)])
    own = _rows(spark, path).select(F.from_json("line", row, {"mode": "PERMISSIVE"}).alias("x"))
    return facts(own.where("x.kind = 'event' and x.event is not null").select("x.event.*"))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """source_path, old_size, new_size: what the files measured at both times."""
    row = "source_path string, old_size long, new_size long"
    return _rows(spark, path).select(F.from_json("line", row, {"mode": "PERMISSIVE"}).alias("x")).select("x.*").where("source_path is not null")
