"""Exact substring dedup: seed on winnowed anchors, extend, keep maximal repeats.

Documents travel in packets of a few MB (Arrow batches as bytes), so that one hash exchange row stands for
many documents. 1. Seed: of every ``window`` words the smallest hash of ``seed`` words is an anchor
(winnowing: equal windows have equal anchors). Each packet sends its distinct anchors, with the smallest and
largest document holding them, to hash buckets, which answer one bit for each: do two documents hold it?
2. Extend: a shared anchor is extended both ways to every window that it is the anchor of; packets send pairs
of the anchor and the window's hash, and get one bit for each: does a smaller document elsewhere hold the
same window around the same anchor? 3. Neighbouring repeated windows are merged into maximal repeats of at
least ``window`` words, which are cut out.

Documents are joined through their anchors' buckets, not in pairs: a passage that a third of all documents
share is one row a packet in one bucket. Anchor and window hashes come from two families of word hashes with
bases of their own (words over 64 bytes are hashed by XXH3, as polynomials modulo 2^64 have known collisions
among long words), so windows are taken for equal if 2 x 64 bits agree. Buckets are the top bits of a hash,
as many as the texts need for ``bucket_chars`` each; a packet sends rows for those that it has hashes in.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import mapped, mix, rolling, small_batches, stored

_P = np.uint64(0x100000001B3 * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF | 1)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_Q = np.uint64(0x9FB21C651E98DF25)
_LONG = 64
_NONE = np.iinfo(np.int64).max


class Words:
    """The words of a packet's documents, one after another."""

    def __init__(self, texts: list[bytes | None]) -> None:
        split = [(t or b"").split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.doc = np.repeat(np.arange(len(split)), self.counts)
        self.split = split
        joined = np.frombuffer(b" ".join([b" ".join(w) for w in split if w]), np.uint8)
        n = len(joined)
        spaces = np.flatnonzero(joined == 32)
        starts = np.concatenate(([0], spaces + 1)) if n else np.empty(0, np.int64)
        ends = np.concatenate((spaces, [n])) if n else np.empty(0, np.int64)
        self._joined, self._starts, self._ends = joined, starts, ends
        self.hashes = self._hashed(_P, 0)

    def _hashed(self, base: np.uint64, seed: int) -> np.ndarray:
        """A hash of each word, of the family of ``base``."""
        n, starts, ends = len(self._joined), self._starts, self._ends
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(_LONG, base))))
        place = np.arange(n) - np.repeat(starts, ends - starts + 1)[:n]  # in the word; a space goes with the word before it
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self._joined + np.uint64(7)) * up[np.minimum(place, _LONG, out=place)], out=total[1:])
        out = mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))
        for k in np.flatnonzero(ends - starts > _LONG):
            out[k] = xxhash.xxh3_64_intdigest(self._joined[starts[k] : ends[k]].tobytes(), seed)
        return out

    @functools.cached_property
    def other(self) -> np.ndarray:
        """Hashes of a second family."""
        return self._hashed(_Q, 1)

    def windows(self, size: int) -> np.ndarray:
        """Starts of windows within one document."""
        n = len(self.doc) - size + 1
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n > 0 else np.empty(0, np.int64)


def _anchors(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows' starts and the hash of each one's anchor."""
    at = words.windows(window)
    if not len(at):
        return at, np.empty(0, np.uint64)
    grams = rolling(words.hashes, seed)
    low, width = grams, 1
    need = window - seed + 1
    while width * 2 <= need:  # minima of windows by doubling
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    n = len(grams) - need + 1
    low = np.minimum(low[:n], low[need - width : need - width + n])
    return at, low[at]


def _first(hashes: np.ndarray, ids: np.ndarray, tied: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the smallest id of each, its largest id or else the hash it is tied to, and each one's index."""
    order = np.lexsort((ids, hashes) if tied is None else (ids, tied, hashes))
    h, d = hashes[order], ids[order]
    if not len(h):
        return h, d, d if tied is None else tied, np.empty(0, np.int64)
    new = np.concatenate(([True], h[1:] != h[:-1]))
    if tied is not None:
        t = tied[order]
        new[1:] |= t[1:] != t[:-1]
    start = np.flatnonzero(new)
    index = np.empty(len(h), np.int64)
    index[order] = np.cumsum(new) - 1
    return h[start], d[start], d[np.append(start[1:], len(h)) - 1] if tied is None else t[start], index


def _ranges(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that ordered ``hashes`` fall in, by their top bits, and where each begins and ends."""
    if not len(hashes):
        return (np.empty(0, np.int64),) * 3
    top = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    start = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    return top[start], start, np.append(start[1:], len(top))


def _deal(packet: int, hashes: np.ndarray, low: np.ndarray, third: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that the packet's distinct hashes fall in."""
    some, starts, ends = _ranges(hashes, bits)
    body = np.stack((hashes.view(np.int64), low, third.view(np.int64)))
    rows = [body[:, s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array(np.full(len(some), packet)), pa.array(rows, pa.binary())], names=["bucket", "packet", "body"])


def _answer(shared: bool):
    """For each row of a bucket a bit for each hash: shared by two ids, or, tied to the same hash, held by an id below the row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(bucket: int, rows: list) -> pa.RecordBatch:
            parts = [np.frombuffer(b, np.int64).reshape(3, -1) for _, b in rows]
            h, low, third = np.ascontiguousarray(np.concatenate(parts, axis=1))
            if shared:
                distinct, least, _, index = _first(h.view(np.uint64), low)
                most = np.full(len(distinct), np.iinfo(np.int64).min)
                np.maximum.at(most, index, third)
                bits = (least < most)[index]
            else:
                _, least, _, index = _first(h.view(np.uint64), low, third.view(np.uint64))
                bits = least[index] < low
            ends = np.cumsum([p.shape[1] for p in parts])[:-1]
            return pa.record_batch([pa.array([p for p, _ in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([np.packbits(x).tobytes() for x in np.split(bits, ends)], pa.binary())], names=["packet", "bucket", "bits"])

        held, now = [], None
        for batch in batches:
            for bucket, packet, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now and held:
                    yield settle(now, held)
                    held = []
                now = bucket
                held.append((packet, body))
        if held:
            yield settle(now, held)

    return run


def _bits(answers: list[dict], hashes: np.ndarray, bits: int) -> np.ndarray:
    some, starts, ends = _ranges(hashes, bits)
    out = np.zeros(len(hashes), bool)
    for a in answers or ():
        k = int(np.searchsorted(some, a["bucket"]))
        s, e = starts[k], ends[k]
        out[s:e] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=e - s).astype(bool)
    return out


def _opened(body: bytes, id_col: str, text_col: str):
    batch = pa.ipc.open_stream(body).read_next_batch()
    ids = batch.column(id_col).cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False)
    return batch, ids, Words(batch.column(text_col).cast(pa.binary()).to_pylist())


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, seed: int = 6, packet_chars: int = 1 << 20, bucket_chars: int = 16 << 20) -> DataFrame:
    """``docs`` with n_words, n_removed, spans (array of start, end: maximal repeats, in words) and kept_text.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id. Windows
    are judged on the input. kept_text: the kept words, joined by one space. Null and empty texts have no
    words; shorter ones than ``window`` keep all; a null id is never smaller than another nor keeps its
    repeats from being looked up, so its row loses nothing; rows with equal ids are one document's. All
    columns of ``docs`` come back as they were; none may have the names of the four added.
    """
    if clash := {"n_words", "n_removed", "spans", "kept_text"} & set(docs.columns):
        raise ValueError(f"documents already have {sorted(clash)}")
    fields = docs.schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, n, chars, held = TaskContext.get().partitionId() << 32, 0, 0, 0, []

        def out():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as w:
                w.write_batch(whole)
            return pa.record_batch([pa.array([task + k]), pa.array([chars]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["packet", "chars", "body"])

        for batch in batches:
            sizes = np.cumsum([len(x or "") for x in batch.column(text_col).to_pylist()])
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + packet_chars - chars, "right")))
                held.append(batch.slice(at, to - at))
                chars, n, at = int(chars + sizes[to - 1] - done), n + to - at, to
                if chars >= packet_chars or at < batch.num_rows:
                    yield out()
                    k, n, chars, held = k + 1, 0, 0, []
        if held:
            yield out()

    small_batches(docs.sparkSession)
    packets = stored(mapped(docs, pack, "packet long, chars long, body binary"), "packets")
    total = packets.agg(F.sum("chars")).first()[0] or 0
    buckets = max(0, -(-total // bucket_chars) - 1).bit_length()  # in bits

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packet, body in _each(batches):
            _, ids, words = _opened(body, id_col, text_col)
            at, anchors = _anchors(words, window, seed)
            own = ids[words.doc[at]]
            yield from _deal(packet, *_first(anchors[own != _NONE], own[own != _NONE])[:3], buckets)

    def exchange(sent: DataFrame, shared: bool) -> DataFrame:
        dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
        back = mapped(dealt, _answer(shared), "packet long, bucket int, bits binary")
        return back.groupBy("packet").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))

    sent = mapped(packets.select("packet", "body"), seeds, "bucket int, packet long, body binary")
    seeded = stored(exchange(sent, True), "seeds")

    def around(ids, words, answers):
        """The windows that hold a shared anchor: starts, owners, hashes, anchors."""
        at, anchors = _anchors(words, window, seed)
        own = ids[words.doc[at]]
        some = own != _NONE
        at, anchors, own = at[some], anchors[some], own[some]
        distinct, _, _, index = _first(anchors, own)
        keep = _bits(answers, distinct, buckets)[index]
        at, own, anchors = at[keep], own[keep], anchors[keep]
        return at, own, rolling(words.other, window, _OTHER)[at] if len(at) else np.empty(0, np.uint64), anchors

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packet, body, answers in _each(batches):
            _, ids, words = _opened(body, id_col, text_col)
            _, own, hashes, anchors = around(ids, words, answers)
            yield from _deal(packet, *_first(hashes, own, anchors)[:3], buckets)

    both = packets.select("packet", "body").join(seeded, "packet", "left")
    found = exchange(mapped(both, extend, "bucket int, packet long, body binary"), False)
    found = stored(found.withColumnRenamed("answers", "found"), "windows")
    shape = T.StructType([*fields, *T._parse_datatype_string("n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body, answers, bits in _each(batches):
            batch, ids, words = _opened(body, id_col, text_col)
            at, own, hashes, anchors = around(ids, words, answers)
            distinct, low, _, index = _first(hashes, own, anchors)
            gone = at[_bits(bits, distinct, buckets)[index] | (low[index] < own)]
            edge = np.zeros(len(words.doc) + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + window, -1)
            drop = np.cumsum(edge)[:-1] > 0
            ends = np.cumsum(words.counts)
            removed = np.add.reduceat(np.append(drop, False), np.append(ends - words.counts, len(drop)), dtype=np.int64)[:-1] * (words.counts > 0)
            spans, kept = [], []
            for end, n, m, w in zip(ends.tolist(), words.counts.tolist(), removed.tolist(), words.split, strict=True):
                if not m:
                    spans.append([])
                    kept.append(b" ".join(w).decode())
                    continue
                mine = drop[end - n : end]
                flips = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0])))).reshape(-1, 2)
                spans.append([{"start": s, "end": e} for s, e in flips.tolist()])
                kept.append(b" ".join([x for x, g in zip(w, mine.tolist(), strict=True) if not g]).decode())
            more = [pa.array(words.counts), pa.array(removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
            yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, "n_words", "n_removed", "spans", "kept_text"])

    return mapped(both.join(found, "packet", "left"), cut, shape)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)
