"""SimHash near-duplicates, linked by a self-join of binary tries.

Fingerprints are made in Arrow batches. Distinct fingerprints are dealt by bit blocks: of ``blocks`` blocks
at least ``blocks - errors`` agree between two fingerprints at ``errors`` differing bits or fewer, so each
choice of agreeing blocks is a key, and any linked pair meets under some key. Under a key the fingerprints
form one binary trie, as a sorted array; pairs of its nodes are walked together, differing bits are added up,
and a pair of nodes is dropped once it is over the budget. A task emits the spanning forest of the links it
finds, never the pairs. A key with many fingerprints is cut into chunks that meet pairwise in cells of their
own, so no task holds an unbounded group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import mapped, small_batches, stored
from tracelake.llm.graph import components, forest

SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """The text's 64 bits; zero without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):  # a very long text stays in bounded memory
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + 65536], ends[k : k + 65536], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp long) of every row. Null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], names=[id_col, "fp"])

    small_batches(docs.sparkSession)
    return mapped(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")), run, f"{id_col} long, fp long")


def trie_links(values: np.ndarray, errors: int, other: np.ndarray | None = None, start: int = 0, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct ``values`` that differ in ``errors`` bits or fewer.

    Nodes are ranges of the sorted array at a depth. ``start``: bits that surely agree, so that one node for
    each of their values begins the walk. ``other``: a chunk number for each value; only pairs of unequal
    chunks are wanted. A pair of small nodes is compared directly.
    """
    if len(values) < 2:
        return
    head = values >> np.uint64(64 - start) if start else np.zeros(len(values), np.uint64)
    cut = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1], [True])))
    lo, hi = cut[:-1], cut[1:]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    zero = np.zeros(len(lo), np.int64)
    todo = [(lo, hi, lo, hi, zero, start)]
    while todo:
        al, ah, bl, bh, diff, depth = todo.pop()
        if len(al) > block:
            half = len(al) // 2
            todo += [tuple(x[:half] for x in (al, ah, bl, bh, diff)) + (depth,), tuple(x[half:] for x in (al, ah, bl, bh, diff)) + (depth,)]
            continue
        small = ((ah - al) * (bh - bl) <= 64) | (depth >= 64)
        if small.any():
            yield from _compare(values, al[small], ah[small], bl[small], bh[small], errors, other, block)
            big = ~small
            al, ah, bl, bh, diff = al[big], ah[big], bl[big], bh[big], diff[big]
        if not len(al):
            continue
        bit = np.uint64(1 << (63 - depth))
        mask = np.uint64((0xFFFFFFFFFFFFFFFF << (64 - depth)) & 0xFFFFFFFFFFFFFFFF) if depth else np.uint64(0)
        am = np.searchsorted(values, (values[al] & mask) | bit)
        am = np.clip(am, al, ah)
        bm = np.clip(np.searchsorted(values, (values[bl] & mask) | bit), bl, bh)
        same = al == bl
        nxt = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), tuple(x[~same] for x in (am, ah, bl, bm, diff + 1))]
        parts = []
        for p in nxt:
            own = p[0] == p[2]
            ok = (p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= errors) & ~(own & (p[1] - p[0] < 2))
            parts.append(tuple(x[ok] for x in p))
        todo.append(tuple(np.concatenate([p[k] for p in parts]) for k in range(5)) + (depth + 1,))


def _compare(values, al, ah, bl, bh, errors, other, block):
    sizes = (ah - al) * (bh - bl)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + block, "right")))
        n = sizes[at:to]
        node = np.repeat(np.arange(at, to), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (bh - bl)[node]
        i, j = al[node] + k // width, bl[node] + k % width
        ok = (i < j) | (al[node] != bl[node])
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(values[i] ^ values[j]) <= errors
        if other is not None:
            ok &= other[i] != other[j]
        yield i[ok], j[ok]
        at = to


def plan_keys(n: int, errors: int, group: int = 4096) -> list[tuple[int, ...]]:
    """The bit sets of the keys: the fewest blocks for which ``n`` even fingerprints give groups of ``group``."""
    for blocks in range(errors + 1, errors + 5):
        cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
        sets = [tuple(b for c in chosen for b in range(cuts[c], cuts[c + 1])) for chosen in itertools.combinations(range(blocks), blocks - errors)]
        if n <= group * 2 ** min(map(len, sets)):
            break
    return sets


def _gather(values: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The values with the named bits on top, the others below: a permutation of bits."""
    out = np.zeros_like(values)
    for k, b in enumerate([*bits, *(b for b in range(64) if b not in set(bits))]):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - k)
    return out


def links(fps: DataFrame, *, errors: int = 4, chunk: int = 16384) -> DataFrame:
    """(a, b): a spanning set of the links among distinct fingerprints ``fps`` (node long, fp long).

    Nodes are named by any distinct longs. Every pair at ``errors`` bits or fewer is connected by the rows
    returned. Empty input gives no rows.
    """
    n = fps.count()
    sets = plan_keys(max(1, n), errors)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, bits in enumerate(sets):
                turned = _gather(fp.view(np.uint64), bits)
                key = (turned >> np.uint64(64 - len(bits))).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(node), k, np.int32)), pa.array(key), pa.array(node), pa.array(turned.view(np.int64))], names=["k", "key", "node", "turned"])

    dealt = mapped(fps.select("node", "fp"), deal, "k int, key long, node long, turned long")
    hot = dealt.groupBy("k", "key").count().where(F.col("count") > chunk).select("k", "key", F.ceil(F.col("count") / chunk).cast("int").alias("s"))
    hot = stored(hot, "hot")
    if hot.isEmpty():
        cells = dealt.select("k", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("c"), "node", "turned")
    else:  # chunk c of a hot key meets every chunk: cells (min, max) hold two chunks at most
        cells = dealt.join(hot, ["k", "key"], "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
        cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        cells = cells.select("k", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "turned")
    cells = cells.repartition("k", "key", "i", "j").sortWithinPartitions("k", "i", "j", "turned")
    widths = [len(s) for s in sets]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, i, j, c, node, turned in _runs(batches, widths):
            order = np.argsort(turned, kind="stable")
            node, turned, c = node[order], turned[order], c[order]
            label = np.arange(len(node))
            for a, b in trie_links(turned, errors, c if i != j else None, widths[k]):
                label = forest(a, b, label)
            own = np.flatnonzero(label != np.arange(len(node)))
            yield pa.record_batch([pa.array(node[own]), pa.array(node[label[own]])], names=["a", "b"])

    return mapped(cells, join, "a long, b long")


def _runs(batches, widths, at_least: int = 200_000):
    """A sorted partition in pieces that never part a key: at least so many rows, or one key's."""
    held: list[tuple] = []
    size = 0

    def flush(rows):
        cols = [np.concatenate([r[x] for r in rows]) for x in range(6)]
        # rows come as (k, i, j, c, node, turned); one walk for each (k, i, j)
        edge = np.flatnonzero(np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]), [True])))
        for s, e in itertools.pairwise(edge):
            yield int(cols[0][s]), int(cols[1][s]), int(cols[2][s]), cols[3][s:e], cols[4][s:e], cols[5][s:e]

    for batch in batches:
        if not batch.num_rows:
            continue
        get = {f: batch.column(x).to_numpy(zero_copy_only=False) for x, f in enumerate(batch.schema.names)}
        row = (get["k"], get["i"], get["j"], get["c"], get["node"], get["turned"].view(np.uint64))
        if size >= at_least:  # cut where the key changes
            last = held[-1]
            lk, li, lj = last[0][-1], last[1][-1], last[2][-1]
            top = last[5][-1] >> np.uint64(64 - widths[lk])
            shift = np.array([64 - w for w in widths], np.uint64)[row[0]]
            new = (row[0] != lk) | (row[1] != li) | (row[2] != lj) | ((row[5] >> shift) != top)
            if new.any():
                s = int(np.argmax(new))
                held.append(tuple(x[:s] for x in row))
                yield from flush(held)
                held, size = [], 0
                row = tuple(x[s:] for x in row)
        held.append(row)
        size += len(row[0])
    if held:
        yield from flush(held)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, errors: int = 4, chunk: int = 16384) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included. Null texts and texts
    without words have fingerprint zero and link like any other; repeated rows give repeated rows; a null id
    keeps its row and takes the component of its fingerprint, where only null ids give a null component.
    Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    heads = stored(fps.groupBy("fp").agg(F.min(id_col).alias("node")), "heads")
    found = components(links(heads.where("node is not null"), errors=errors, chunk=chunk))
    named = heads.join(found, heads.node == found.id, "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


