"""Benchmark decontamination: a BM25 index of the test items, searched with every passage of the corpus.

Items are indexed as segments; impacts are divided by a segment's own score, so that a passage scores between
0 and 1: the share of the segment's BM25 weight that it holds. A term's postings are the blocks of segments
that have it, each with the largest impact in it. Search is block-max WAND with a fixed threshold: a passage's
terms each have a cursor; in the order of their blocks the terms' largest impacts are added up, and where the
sum reaches the threshold stands the pivot. Cursors behind it jump to it; if the block maxima of the terms
that stand there reach the threshold too, the block's segments are scored, and the cursors go on. Many
passages take these steps together, as rows of arrays; those that can't reach the threshold with all their
terms never start. No bound ever lies below the score, so all segments at the threshold are found. What is
found is verified on the document's words: five-word shingles of the item's question and of its answer, or of
the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import mapped, small_batches

#: Word characters: ASCII letters (case doesn't count) and digits, and all beyond ASCII.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SHINGLE = 5
#: Fixed value: cursors that are moved together; a passage with more is searched alone.
CELLS = 1 << 18


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Sets of five words; of fewer words the whole sequence; of none nothing."""
    return {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def parts(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: an item's last quarter, of five words at least, answers what stands before it."""
    n = max(SHINGLE, len(words) // 4)
    return (words[:-n], words[-n:]) if len(words) >= 2 * SHINGLE else (words, words)


class Index:
    """BM25 impacts of segments: for each term the blocks that have it, with their maxima. Size goes with the number of words."""

    def __init__(self, items: list[tuple[int, str]], *, segment: int, block: int, k1: float = 1.2, b: float = 0.75) -> None:
        self.items, self.words = [], []
        found = []  # (item's place, words of a segment)
        for item, text in items:
            words = split_words(text)
            if not words:
                continue
            place = len(self.items)
            self.items.append(item)
            self.words.append(words)
            pieces = max(1, -(-len(words) // segment))
            cuts = [round(k * len(words) / pieces) for k in range(pieces + 1)]
            found += [(place, words[s:e]) for s, e in zip(cuts, cuts[1:])]  # noqa: B905
        self.terms: dict[bytes, int] = {}
        df: dict[bytes, int] = {}
        for _, w in found:
            for x in set(w):
                df[x] = df.get(x, 0) + 1
        # segments with the same common word lie together, so that block maxima are low elsewhere
        common = lambda w: max((df[x], x) for x in w)[1]
        found.sort(key=lambda f: (common(f[1]), len(f[1]), f[0]))
        for _, w in found:
            for x in w:
                self.terms.setdefault(x, len(self.terms))
        self.place = np.array([p for p, _ in found], np.int64)
        n, mean = len(found), np.mean([len(w) for _, w in found]) if found else 1
        at, value = [], []  # postings: term and segment, impact
        for k, (_, w) in enumerate(found):
            counts: dict[bytes, int] = {}
            for x in w:
                counts[x] = counts.get(x, 0) + 1
            raw = {x: np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(w) / mean)) for x, c in counts.items()}
            total = sum(raw.values())
            for x, v in raw.items():
                at.append(self.terms[x] * n + k)
                value.append(v / total)
        self.block = block
        self.blocks = -(-n // block) if n else 0
        term, place = np.divmod(np.array(at, np.int64), max(n, 1))
        # a row for each term and block that has it, by term; the last row is for those without
        self.keys, row = np.unique(term * self.blocks + place // block, return_inverse=True)
        self.cells = np.zeros((len(self.keys) + 1, block), np.float32)
        self.cells[row, place % block] = value
        self.peak = self.cells.max(axis=1)
        self.heads = np.searchsorted(self.keys, np.arange(len(self.terms) + 1) * self.blocks)
        self.top = np.maximum.reduceat(self.peak, self.heads[:-1]) if n else np.zeros(1, np.float32)

    def _block(self, at: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The block that each term's cursor stands at; one past the last for cursors at their end."""
        out = np.full(at.shape, self.blocks, np.int64)
        ok = at < self.heads[term + 1]
        out[ok] = self.keys[at[ok]] - term[ok] * self.blocks
        return out

    def pivots(self, term: np.ndarray, owned: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block maxima reach the threshold. term: a row of distinct terms a passage, where ``owned``."""
        who = np.arange(len(term))
        term = np.where(owned, term, 0)
        at = np.where(owned, self.heads[term], self.heads[term + 1])
        most = np.where(owned, self.top[term], 0).astype(np.float64)
        found = []
        while len(who):
            now = self._block(at, term)
            order = np.argsort(now, axis=1, kind="stable")
            reach = np.cumsum(np.take_along_axis(most, order, axis=1), axis=1) >= threshold
            first = np.argmax(reach, axis=1)
            pivot = np.take_along_axis(now, np.take_along_axis(order, first[:, None], axis=1), axis=1)[:, 0]
            go = reach.any(axis=1) & (pivot < self.blocks)
            who, term, at, most, now, pivot = who[go], term[go], at[go], most[go], now[go], pivot[go]
            behind = now < pivot[:, None]
            at[behind] = np.searchsorted(self.keys, term[behind] * self.blocks + np.broadcast_to(pivot[:, None], now.shape)[behind])
            now[behind] = self._block(at[behind], term[behind])
            here = now == pivot[:, None]
            bound = np.where(here, self.peak[np.minimum(at, len(self.keys))], 0).sum(axis=1, dtype=np.float64)
            hit = bound >= threshold - 2e-4
            found.append((who[hit], pivot[hit]))
            at[here] += 1
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        p, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return p, b

    def search(self, terms: np.ndarray, doc: np.ndarray, passage: int, threshold: float) -> np.ndarray:
        """(document, item's place, score) rows for the terms of several documents, one after another.

        Passages are ``passage`` words long and overlap by half. terms: -1 for words of no item.
        """
        half = passage // 2
        n = len(terms)
        none = np.empty((0, 3))
        if not n or not self.blocks:
            return none
        first = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1))
        own = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))  # place in the document
        piece = own // half
        slot = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])))) - 1  # halves of passages
        some = terms >= 0
        if not some.any():
            return none
        size = len(self.terms)
        last = np.zeros(slot[-1] + 2, bool)  # a slot that begins a document
        last[slot[first]] = True
        # passage s: slots s and s+1 of one document
        key = slot[some] * size + terms[some]
        back = key[~last[slot[some]]] - size
        both = np.unique(np.concatenate((key, back)))
        where, term = both // size, both % size
        bound = np.bincount(where, self.top[term], minlength=slot[-1] + 1)
        keep = bound[where] >= threshold
        where, term = where[keep], term[keep]
        if not len(where):
            return none
        starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        owner = doc[np.searchsorted(slot, where[starts])]
        ends = np.append(starts[1:], len(where))
        out = []
        s = 0
        while s < len(starts):  # as many passages as fit into a bounded number of cursors
            e = min(len(starts), s + max(1, CELLS // passage))
            num = ends[s:e] - starts[s:e]
            place = np.arange(num.max())
            owned = place < num[:, None]
            rows = np.where(owned, term[np.minimum(starts[s:e, None] + place, len(term) - 1)], 0)
            p, blk = self.pivots(rows, owned, threshold - 2e-4)
            for x in range(0, len(p), 8192):  # the terms of each surviving passage and block
                pp, bb = p[x : x + 8192], blk[x : x + 8192]
                nn = num[pp]
                heads = np.cumsum(nn) - nn
                at = np.repeat(starts[s + pp] - heads, nn) + np.arange(nn.sum())
                key = term[at] * self.blocks + np.repeat(bb, nn)
                row = np.searchsorted(self.keys, key)
                row[self.keys[np.minimum(row, len(self.keys) - 1)] != key] = len(self.keys)
                scores = np.add.reduceat(self.cells[row], heads, axis=0)
                row, k = np.nonzero(scores >= threshold - 1e-4)
                out.append(np.stack((owner[s + pp[row]], self.place[bb[row] * self.block + k], scores[row, k]), axis=1))
            s = e
        return np.concatenate(out) if out else none


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", passage: int = 128, threshold: float = 0.5, overlap: float = 0.8, shard: int = 50_000, words: int = 1_000_000, block: int = 8) -> DataFrame:
    """(id_col, item_col, score, question_overlap, answer_overlap): documents that hold a test item.

    The best passage score of each document and item with at least ``threshold``, where the document holds
    at least ``overlap`` of the five-word shingles of both the item's question and its answer, or of the whole
    item: a short answer has so few shingles that one changed word would decide. Benchmarks of
    any size are indexed at most ``shard`` items (on average, if there are more) and ``words`` words at a time,
    but at least one item; each index is a broadcast, of some hundred bytes a word at most, and is searched
    with all documents. Null, empty and wordless texts and items match nothing; items of fewer than five words
    match where their words stand in a row; repeated documents and items each give their rows once; ids that
    are null are dropped; an empty side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    shards = max(1, -(-n // shard), min(n, -(-size // (8 * words))))
    out = None
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k) if shards > 1 else items
        for some in _packs(sorted((r[0], r[1]) for r in own.collect()), words):
            index = spark.sparkContext.broadcast(Index(some, segment=passage // 2, block=block))
            found = _search(docs, index, id_col, text_col, item_col, passage, threshold, overlap)
            out = found if out is None else out.union(found)
    return out.groupBy(id_col, item_col).agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def _packs(items: list[tuple[int, str]], words: int) -> list[list[tuple[int, str]]]:
    """``items`` in order, in lists of at most ``words`` words; one item with more is alone. At least one list."""
    out, held = [[]], 0
    for item in items:
        n = len(split_words(item[1]))
        if out[-1] and held + n > words:
            out.append([])
            held = 0
        out[-1].append(item)
        held += n
    return out


def _search(docs, index, id_col, text_col, item_col, passage, threshold, overlap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        get = ix.terms.get
        sides = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            texts = batch.column(1)
            for s in range(0, batch.num_rows, 500):
                split = [split_words(t) for t in texts.slice(s, 500).to_pylist()]
                counts = [len(w) for w in split]
                terms = np.fromiter(chain.from_iterable(map(get, w, repeat(-1)) for w in split), np.int64, sum(counts))
                best: dict[tuple[int, int], float] = {}
                for d, p, score in ix.search(terms, np.repeat(np.arange(len(split)), counts), passage, threshold):
                    best[int(d), int(p)] = max(best.get((int(d), int(p)), 0), float(score))
                mine, now = set(), None
                for (d, p), score in sorted(best.items()):
                    if p not in sides:
                        sides[p] = [shingles(x) for x in (*parts(ix.words[p]), ix.words[p])]
                    if d != now:  # the document's shingles, as long as they are needed
                        now, mine = d, shingles(split[d])
                        short = set(split[d])
                    held = []
                    for side in sides[p]:
                        if len(next(iter(side))) < SHINGLE:
                            held.append(_has(split[d], next(iter(side))) if next(iter(side))[0] in short else 0.0)
                        else:
                            held.append(len(side & mine) / len(side))
                    *held, whole = held
                    if max(min(held), whole) >= overlap:
                        rows.append((ids[s + d], ix.items[p], min(1.0, score), *held))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[id_col, item_col, "score", "question_overlap", "answer_overlap"])

    some = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull())
    return mapped(some, run, f"{id_col} long, {item_col} long, score double, question_overlap double, answer_overlap double")


def _has(words: list[bytes], short: tuple[bytes, ...]) -> float:
    """1 if the words hold the short sequence."""
    n = len(short)
    return float(any(tuple(words[k : k + n]) == short for k in range(len(words) - n + 1)))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that hold a test item; a null id is never found, so its row stays."""
    bad = contamination(docs, benchmark, id_col=id_col, **options).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
