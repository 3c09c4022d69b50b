"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the principal axes is learned on a bounded sample so that signs give balanced binary codes.
Tables take some of a code's bits each as their key; how many bits and tables follows from the number of
vectors, so that buckets stay small and a pair at the least cosine meets in some table almost surely. Vectors
of one label that agree on a key meet in that table's bucket, where pairs whose codes differ in more bits than
such a pair's would are dropped and cosines of the original vectors decide in double precision. A pair that
meets in several tables is counted in the first. Tasks emit sums and spanning forests, never the pairs; equal
vectors (by two 64-bit hashes) are one row with a multiplicity; a large bucket is cut into chunks that meet
pairwise in cells of their own. Vectors travel as bytes, in single precision where they are stored so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.llm.graph import components, forest


def learn(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 0) -> np.ndarray:
    """Columns that unit vectors are multiplied with; the signs are the code. Balanced by the rotation."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    if not len(sample):
        return np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :bits]
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1][:, :bits]
    v = sample @ axes
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return axes @ r


def plan(n: int, bits: int, least: float, miss: float = 0.015) -> tuple[np.ndarray, int]:
    """Masks of the tables' keys for ``n`` vectors of one label, and the most bits in which linked codes may differ.

    Each bit differs with probability acos(least) / pi. Keys have 10 bits or so many that 64 vectors share one;
    a pair misses all tables with probability ``miss``, and is over the limit of bits in one of a thousand.
    """
    differ = math.acos(max(-1.0, min(1.0, least))) / math.pi
    width = max(1, min(bits, max(10, math.ceil(math.log2(max(1, n / 64))))))
    meet = (1 - differ) ** width
    tables = 1 if meet >= 1 else math.ceil(math.log(miss) / math.log(1 - meet))
    rng, masks = np.random.default_rng(0), []
    while len(masks) < tables:
        order = np.arange(bits) if not masks else rng.permutation(bits)
        parts = min(max(1, bits // width), tables - len(masks))
        # the first cut uses all bits; later ones are of the planned width
        edge = [round(k * bits / parts) for k in range(parts + 1)] if not masks and parts == bits // width else [k * width for k in range(parts + 1)]
        masks += [sum(1 << int(b) for b in order[s:e]) for s, e in zip(edge, edge[1:])]  # noqa: B905
    tail, limit = 1.0, -1
    while tail > 1e-3 and limit < bits:
        limit += 1
        tail -= math.comb(bits, limit) * differ**limit * (1 - differ) ** (bits - limit)
    return np.array(masks, np.uint64), limit


def codes(units: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    bits = (units @ rotation > 0).astype(np.uint8)
    padded = np.zeros((len(bits), 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).ravel()


def _dense(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    num = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(num), dim), flat.dtype)
    ends = np.cumsum(num)
    out[np.repeat(np.arange(len(num)), num), np.arange(num.sum()) - np.repeat(ends - num, num)] = flat
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    out = rows.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def pairs(group: np.ndarray, chunk: np.ndarray, cross: np.ndarray, table: np.ndarray, code: np.ndarray, units: np.ndarray, masks: np.ndarray, limit: int, least: float, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within equal ``group`` numbers (sorted) that have the cosine, each in its first table.

    In groups of ``cross`` cells only pairs of unequal chunks count.
    """
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = cut[:-1], cut[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]

    def sift(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = ~cross[i] | (chunk[i] != chunk[j])
        x = code[i] ^ code[j]
        ok &= np.bitwise_count(x) <= limit
        for t, m in enumerate(masks[:-1]):
            ok &= (table[i] <= t) | ((x & m) != 0)
        return i[ok], j[ok]

    small = hi - lo <= 64
    size = (hi - lo)[small] ** 2
    ends, a = np.cumsum(size), lo[small]
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 19), "right")))
        n, width = size[at:to], (hi - lo)[small][at:to]
        g = np.repeat(np.arange(to - at), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = a[at:to][g] + k // width[g], a[at:to][g] + k % width[g]
        i, j = sift(i[i < j], j[i < j])
        ok = np.einsum("ij,ij->i", units[i], units[j]) >= least
        yield i[ok], j[ok]
        at = to
    for s, e in zip(lo[~small], hi[~small], strict=True):
        for p in range(s, e, block):
            for q in range(p, e, block):
                i, j = np.nonzero(units[p : min(p + block, e)] @ units[q : min(q + block, e)].T >= least)
                i, j = i + p, j + q
                yield sift(i[i < j], j[i < j])


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, sample: int = 20000, chunk: int = 4096) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and not null and the cosine is at least ``least``. Null and zero
    vectors, those with null or non-finite components, and null labels or ids link with nothing: no links,
    their own component, kept. Shorter vectors count as filled up with zeros. Equal vectors of one label are
    links of each other without being paired. The rotation is learned on at most ``sample`` distinct vectors
    in the order of a hash; all rows are indexed. component_id is the smallest id reachable; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind, width = ("float", np.float32) if kind == "float" else ("double", np.float64)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    same = ["label", "h1", "h2"]
    v = stored(v.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.reverse("v"))}), "vectors")
    good = v.where("ok")
    reps = stored(good.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("many"), F.first("v").alias("v")), "distinct")
    told = reps.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).agg(F.max("n"), F.max("dim")).first()
    n, dim = told[0] or 0, told[1] or 1
    some = reps.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow().column(0).combine_chunks()
    bits = min(64, dim)
    rotation = learn(_units(_dense(some, dim)) if len(some) else np.empty((0, dim)), bits)
    masks, limit = plan(n, bits, least)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.ascontiguousarray(_dense(batch.column(3), dim).astype(width))
            code = codes(_units(rows), rotation)
            body = pa.array([r.tobytes() for r in rows], pa.binary())
            for t, m in enumerate(masks):
                n = len(code)
                yield pa.record_batch([batch.column(0), pa.array(np.full(n, t, np.int32)), pa.array((code & m).view(np.int64)), *batch.columns[1:3], pa.array(code.view(np.int64)), body], names=["label", "t", "key", "rep", "many", "code", "v"])

    dealt = reps.select("label", "rep", "many", "v").mapInArrow(deal, "label string, t int, key long, rep long, many long, code long, v binary")
    hot = stored(dealt.groupBy("label", "t", "key").count().where(F.col("count") > chunk).select("label", "t", "key", F.ceil(F.col("count") / chunk).cast("int").alias("s")), "hot")
    if hot.isEmpty():
        cells = dealt.withColumns({"i": F.lit(0), "j": F.lit(0), "c": F.lit(0)})
    else:
        cells = dealt.join(hot, ["label", "t", "key"], "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("s")).cast("int"))
        cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")})
    order = ["label", "t", "key", "i", "j"]
    cells = cells.repartition(*order).sortWithinPartitions(*order).select(F.xxhash64(*order).alias("g"), "t", (F.col("i") != F.col("j")).alias("x"), "c", "rep", "many", "code", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches):
            get = lambda k: b.column(k).to_numpy(zero_copy_only=False)
            g, t, x, c, rep, many, code = (get(k) for k in ("g", "t", "x", "c", "rep", "many", "code"))
            n = np.zeros(len(g), np.int64)
            label = np.arange(len(g))
            rows = np.frombuffer(b"".join(b.column("v").to_pylist()), width).reshape(-1, dim)
            for i, j in pairs(g, c, x, t, code.view(np.uint64), _units(rows), masks, limit, least):
                np.add.at(n, i, many[j])
                np.add.at(n, j, many[i])
                label = forest(i, j, label)
            some, own = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(g)))
            yield pa.record_batch([pa.array(np.concatenate((rep[some], rep[own]))), pa.array(np.concatenate((rep[some], rep[label[own]]))), pa.array(np.concatenate((n[some], np.zeros(len(own), np.int64))))], names=["a", "b", "n"])

    met = stored(cells.mapInArrow(meet, "a long, b long, n long"), "met")
    counts = met.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    found = components(met.select("a", "b"))
    named = reps.join(counts, "rep", "left").join(found, F.col("rep") == found.id, "left")
    named = named.select(*same, (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("id", *same).join(named, same).select("id", "n_links", "component_id")
    alone = v.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _whole_groups(batches: Iterator[pa.RecordBatch], at_least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """A partition in record batches that never part a group g."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= at_least:
            g = batch.column("g").to_numpy()
            new = np.flatnonzero(g != held[-1].column("g")[-1].as_py())
            if len(new):
                held.append(batch.slice(0, new[0]))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, batch = [], 0, batch.slice(new[0])
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
