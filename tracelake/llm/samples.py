"""Bounded training samples, in an order that only hashes of ids decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import held_out

Y = "y"


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, each: int, id_col: str = "doc_id", only: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(doc, a struct of ``docs``' columns; y) of the learning folds, at most ``each`` ids of every class in ``only``.

    Classes are taken in the order of a hash of the id. A document labelled twice has its larger label. At
    most ``each * len(only)`` narrow rows are broadcast, so the bound is a parameter and texts aren't shuffled.
    """
    label_id, label_y = _fresh(docs, "label_id"), _fresh(docs, Y)
    own = labels.select(F.col(id_col).alias(label_id), F.col(label).cast("int").alias(label_y)).where(F.col(label_y).isNotNull() & F.col(label_id).isNotNull() & ~held_out(F.col(label_id)))
    own = own.groupBy(label_id).agg(F.max(label_y).alias(label_y))
    parts = [own.where(F.col(label_y) == y).orderBy(F.xxhash64(label_id), label_id).limit(each) for y in only]
    some = parts[0]
    for p in parts[1:]:
        some = some.union(p)
    found = docs.join(F.broadcast(some), F.col(id_col) == F.col(label_id)).dropDuplicates([label_id])
    return found.select(F.struct(*docs.columns).alias("doc"), F.col(label_y).alias(Y))


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def shares(labels: DataFrame, label: str, id_col: str = "doc_id") -> dict[int, int]:
    """Rows of each class in the learning folds."""
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return {int(r[0]): int(r[1]) for r in own.groupBy(F.col(label).cast("int")).count().collect()}  # two rows


def unlabelled(docs: DataFrame, *, n: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``n`` documents of the learning folds, whatever their labels, by a hash of the id; of rows with one id one.

    Ids below a rate that gives a quarter more are looked at, and the ``n`` smallest hashes broadcast.
    """
    wanted = _fresh(docs, "wanted_id")
    ids = docs.select(F.col(id_col).alias(wanted)).where(F.col(wanted).isNotNull() & ~held_out(F.col(wanted)))
    h = F.xxhash64(F.col(wanted).cast("long"), F.lit(7))
    total = ids.agg(F.approx_count_distinct(wanted, 0.02)).first()[0]
    rate = min(1.0, 1.25 * n / max(1, total))
    near = ids if rate == 1 else ids.where(h < int((rate - 0.5) * 2**64))
    some = near.distinct().orderBy(h, wanted).limit(n)
    return docs.join(F.broadcast(some), F.col(id_col) == F.col(wanted)).dropDuplicates([wanted]).select(*docs.columns)
