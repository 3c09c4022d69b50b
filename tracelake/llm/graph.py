"""Connected components over links that never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import mapped, stored


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Lower ``label`` (an index's smallest known partner) until it is constant over the links a-b."""
    while len(a):
        la, lb = label[a], label[b]
        keep = la != lb
        if not keep.any():
            break
        a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars on their smallest members, batch by batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        both = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        ids, flat = np.unique(both, return_inverse=True)
        flat = flat.reshape(2, -1)
        label = forest(flat[0], flat[1], np.arange(len(ids)))
        own = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.record_batch([pa.array(ids[own]), pa.array(ids[label[own]])], names=["a", "b"])


def _size(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``links`` (two long columns): the smallest id reachable.

    Large-star and small-star rounds. Minima are aggregated before the shuffle and neighbours are never
    gathered into lists, so a hub with most of the links is only a skewed join key, which adaptive execution
    splits. Each round is written to the shared folder. Links with a null end are dropped; a link of an id
    with itself is no link; no links give no rows.
    """
    x, y = links.columns
    edges = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a is not null and b is not null and a <> b")
    edges = stored(mapped(edges, _contract, "a long, b long").distinct(), "links")
    before = _size(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(hung.union(low).distinct(), "links")
        after = _size(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
