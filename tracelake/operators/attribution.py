"""Events to project roots: the longest registered root that covers a path by whole segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.paths import Mounts, registry_key


def attribute(paths: DataFrame, registry: DataFrame, *, path_col: str = "cwd", mounts: Mounts | None = None) -> DataFrame:
    """``paths`` with project_root and project_root_source.

    Each path's ancestors are looked up by an equi-join on the distinct paths, so neither side need be small
    and no pair is compared that doesn't share a key. Without a root the path itself is kept as
    ``unattributed``; a blank path is ``missing_cwd``; an absent one has neither. registry: root_key,
    root_path, root_source.
    """
    own = paths.select(F.col(path_col).alias("_p")).where("_p is not null").distinct().withColumn("_k", registry_key(F.col("_p"), mounts))
    parts = F.split("_k", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = F.when(F.col("_k") != "", F.filter(F.array_distinct(F.concat(up, F.when(F.col("_k") == "/", F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")))), lambda x: x != ""))
    found = own.select("_p", F.explode(up).alias("root_key")).join(registry.select("root_key", "root_path", "root_source"), "root_key")
    best = found.groupBy("_p").agg(F.max_by(F.struct("root_path", "root_source"), F.length("root_key")).alias("_root"))
    out = paths.join(best, F.col(path_col) == F.col("_p"), "left")
    blank = ~F.col(path_col).rlike(r"\S")
    root = F.when(F.col("_root").isNotNull(), F.col("_root.root_path")).when(~blank, F.regexp_replace(path_col, r"^\s+|\s+$", ""))
    source = F.when(F.col("_root").isNotNull(), F.col("_root.root_source")).when(blank, "missing_cwd").when(F.col(path_col).isNotNull(), "unattributed")
    return out.withColumns({"project_root": root, "project_root_source": source}).drop("_p", "_root")


def summary(attributed: DataFrame) -> DataFrame:
    """Events by root and source."""
    return attributed.groupBy("project_root", "project_root_source").agg(F.count("*").alias("events"))
