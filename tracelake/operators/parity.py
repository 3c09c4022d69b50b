"""Two extractions of the same data, aligned by ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = ["provider", "location", "source_path"]
#: The fields that must agree, and those whose difference is only noted.
MUST = ["session_id", "model", "effort", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "message_id", "request_id"]
ADVISORY = ["cwd", "project_root"]
COUNTS = ["facts", "matched", "must_mismatch", "advisory", "missing", "growth", "unknown_extra", "extra"]


def facts(events: DataFrame) -> DataFrame:
    """Usage events as facts."""
    own = events.where("event_type = 'usage'")
    use = F.col("usage")
    return own.select(
        F.col("source_type").alias("provider"), F.col("source_location").alias("location"), "source_path", "seq", F.col("source_session_id").alias("session_id"), "model", "effort", "cwd", "project_root",
        use["input"].alias("input_tokens"), use["output"].alias("output_tokens"), use["cache_creation"].alias("cache_creation_tokens"), use["cache_read"].alias("cache_read_tokens"), "message_id", "request_id",
    )


def align(old: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A row for each ordinal of each bucket: in_old, in_new, must (names that differ), advisory, grew.

    files: source_path, old_size, new_size. Where a size is unknown a source has not grown.
    """
    line = W.partitionBy(*BUCKET).orderBy("seq")
    fields = MUST + ADVISORY
    side = lambda df, p: df.withColumn("ordinal", F.row_number().over(line)).select(*BUCKET, "ordinal", F.struct(*fields).alias(p))
    both = side(old, "o").join(side(new, "n"), [*BUCKET, "ordinal"], "full_outer")
    differ = lambda names: F.filter(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in names)), lambda x: x.isNotNull())
    pair = F.col("o").isNotNull() & F.col("n").isNotNull()
    none = F.array().cast("array<string>")
    both = both.withColumns({"must": F.when(pair, differ(MUST)).otherwise(none), "advisory": F.when(pair, differ(ADVISORY)).otherwise(none), "in_old": F.col("o").isNotNull(), "in_new": F.col("n").isNotNull()})
    if files is None:
        return both.withColumn("grew", F.lit(False)).drop("o", "n")
    known = files.select("source_path", (F.col("old_size") < F.col("new_size")).alias("_g"))
    return both.join(known, "source_path", "left").withColumn("grew", F.coalesce("_g", F.lit(False))).drop("o", "n", "_g")


def report(aligned: DataFrame) -> DataFrame:
    """Counts of each ``provider|location``."""
    pair, extra = F.col("in_old") & F.col("in_new"), ~F.col("in_old")
    n = lambda c: F.count_if(c)
    return aligned.groupBy(F.concat_ws("|", "provider", "location").alias("combo")).agg(
        n(F.col("in_old")).alias("facts"),
        n(pair & (F.size("must") == 0)).alias("matched"),
        n(F.size("must") > 0).alias("must_mismatch"),
        n(F.size("advisory") > 0).alias("advisory"),
        n(~F.col("in_new")).alias("missing"),
        n(extra & F.col("grew")).alias("growth"),
        n(extra & ~F.col("grew")).alias("unknown_extra"),
        n(extra).alias("extra"),
    )


def exit_code(totals: DataFrame, *, report_lost: bool = False) -> int:
    """1 if facts differ, are missing or unexplained ones are there; else 2 if the report couldn't be written, else 0."""
    r = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("must_mismatch", "missing", "unknown_extra"))).first()
    return 1 if r["must_mismatch"] or r["missing"] or r["unknown_extra"] else 2 if report_lost else 0
