"""SentencePiece ids by Unigram Viterbi over a double-array trie.

The vocabulary comes from a public model file, whose path is a parameter. That file is a byte-pair model, which
ranks its pieces and has no probabilities, and tokenizers aren't trained here; so a piece's log score is that
of Zipf's law for its rank. The trie is over UTF-8 bytes, as arrays ``base``, ``check`` and ``piece``: from
node s byte c leads to t = base[s] + c if check[t] = s. Whitespace markers stand only at the front of pieces,
and line feeds in none, so the best path of a text is that of its chunks; each batch's distinct chunks are
solved together, all chunks of similar length at once, long ones place by place; texts only look chunks up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelake.llm.common import mapped, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for the marker's own character in a text; no byte of UTF-8.
_RAW = b"\xff"
#: Chunks of more bytes are solved alone.
LONG = 512


class Vocabulary:
    """Pieces, scores, byte pieces and the trie."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(k).encode() for k in range(size)]
        self.score = np.array([sp.get_score(k) for k in range(size)], np.float64)
        self.byte = np.full(256, -1, np.int32)
        plain = []
        for k in range(size):
            if sp.is_byte(k):
                self.byte[int(self.text[k][3:5], 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                plain.append(k)
        if (self.byte < 0).any():
            raise ValueError("the model has no byte fallback")
        mark = MARK.encode()
        for k in plain:
            if MARK in self.text[k].decode().lstrip(MARK) or b"\n" in self.text[k]:
                raise ValueError("a piece holds a marker or a line feed inside")
        # the rank of a piece among the plain ones, best first, and its share by Zipf's law
        rank = np.empty(len(plain), np.int64)
        rank[np.lexsort((plain, -self.score[plain]))] = np.arange(len(plain))
        self.score[plain] = -np.log(rank + 1.0) - np.log((1.0 / np.arange(1, len(plain) + 1)).sum())
        self.unknown = self.score[plain].min() - 10  # of a character that no piece covers alone
        self.longest = max(len(self.text[k]) for k in plain)
        self._trie({self.text[k]: k for k in plain})
        # what ids decode to: bytes, with markers as spaces; control pieces decode to nothing
        out = []
        for k in range(size):
            if sp.is_byte(k):
                out.append(bytes([int(self.text[k][3:5], 16)]))
            elif sp.is_control(k):
                out.append(b"")
            elif sp.is_unknown(k):
                out.append(" ⁇ ".encode())
            else:
                out.append(self.text[k].replace(mark, b" "))
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_len = np.array([len(x) for x in out], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len

    def _trie(self, pieces: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for text, k in pieces.items():
            node = 0
            for c in text:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = k
        size = len(children) * 2 + 2048
        base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        slot = {0: 0}
        free, fan = 257, 257  # the first free slot that any byte can reach; where wide nodes begin to look
        for node in range(len(children)):
            keys = sorted(children[node])
            s = slot[node]
            piece[s] = value[node]
            if not keys:
                continue
            while used[free]:
                free += 1
            fan = max(fan, free)
            b = max(1, (free if len(keys) == 1 else fan) - keys[0])
            tries = 0
            while any(used[b + c] for c in keys):
                b, tries = b + 1, tries + 1
                if b + 512 > size:
                    grow = size // 2
                    base, check, piece = (np.concatenate((a, np.full(grow, f, np.int32))) for a, f in ((base, 0), (check, -1), (piece, -1)))
                    used.extend(bytes(grow))
                    size += grow
            if tries > 40:
                fan = b + keys[0]
            base[s] = b
            for c in keys:
                used[b + c] = 1
                check[b + c] = s
                slot[children[node][c]] = b + c
        self.base, self.check, self.piece = base, check, piece

    def solve(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks' best paths, one after another, and how many each has.

        Of paths with equal scores the one whose last piece is longer wins at each place, as it is met first.
        """
        n = len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, n)
        order = np.argsort(lengths, kind="stable")
        ids: list[np.ndarray] = []
        counts = np.zeros(n, np.int64)
        places: list[np.ndarray] = []
        at = 0
        while at < n:
            longest = max(1, int(lengths[order[at]]))
            if longest > LONG:
                got, num = self._long(chunks[order[at]])
                counts[order[at]] = num
                ids.append(got)
                places.append(order[at : at + 1])
                at += 1
                continue
            top = longest + (longest >> 3)
            to = at + int(np.searchsorted(lengths[order[at:]], min(top, LONG), "right"))
            to = min(max(to, at + 1), at + max(1, 1_000_000 // (top + 1)))
            own = order[at:to]
            got, num = self._solve([chunks[k] for k in own], lengths[own])
            counts[own] = num
            ids.append(got)
            places.append(own)
            at = to
        if not ids:
            return np.empty(0, np.int32), counts
        flat, who = np.concatenate(ids), np.concatenate(places)
        starts = np.cumsum(counts) - counts  # where each chunk's ids go
        out = np.empty(len(flat), np.int32)
        num = counts[who]
        out[np.repeat(starts[who], num) + np.arange(len(flat)) - np.repeat(np.cumsum(num) - num, num)] = flat
        return out, counts

    def _matches(self, text: np.ndarray, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that begin in [s, e): where, their length and number, by place and length."""
        at, node, found = np.arange(s, e), np.zeros(e - s, np.int32), []
        for n in range(1, self.longest + 1):
            ok = at + n <= len(text)
            at, node = at[ok], node[ok]
            nxt = self.base[node] + text[at + n - 1]
            ok = self.check[nxt] == node
            at, node = at[ok], nxt[ok]
            if not len(at):
                break
            k = self.piece[node]
            hit = k >= 0
            found.append((at[hit], np.full(hit.sum(), n), k[hit]))
        a, n, k = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        order = np.lexsort((n, a))
        return a[order], n[order], k[order]

    def _long(self, chunk: bytes, block: int = 1 << 14) -> tuple[np.ndarray, int]:
        """One chunk's best path: the pieces of a block of places are found together, scores then go from place to place."""
        text = np.frombuffer(chunk, np.uint8)
        size, ahead = len(text), self.longest + 4
        back, last = np.zeros(size + 1, np.uint8), np.full(size + 1, -1, np.int32)
        width = np.ones(256, np.int64)
        width[0xC0:], width[0xE0:], width[0xF0:] = 2, 3, 4
        score, none = self.score, float("-inf")
        best = [0.0] + [none] * ahead  # of the places from s on
        for s in range(0, size, block):
            e = min(size, s + block)
            at, num, ids = self._matches(text, s, e)
            cuts = np.searchsorted(at, np.arange(s, e + 1)).tolist()
            gain, num, ids = score[ids].tolist(), num.tolist(), ids.tolist()
            char = np.minimum(width[text[s:e]], size - np.arange(s, e)).tolist()
            best += [none] * (e - s + ahead + 1 - len(best))
            for p in range(e - s):
                now = best[p]
                if now == none:
                    continue
                alone, c = False, char[p]
                for j in range(cuts[p], cuts[p + 1]):
                    n = num[j]
                    alone = alone or n == c
                    if now + gain[j] > best[p + n]:
                        best[p + n] = now + gain[j]
                        back[s + p + n], last[s + p + n] = n, ids[j]
                if not alone and now + self.unknown > best[p + c]:
                    best[p + c] = now + self.unknown
                    back[s + p + c], last[s + p + c] = c, -1
            best = best[e - s :]
        out, p = [], size
        while p:
            n = int(back[p])
            if last[p] >= 0:
                out.append(int(last[p]))
            else:
                out += [int(self.byte[b]) for b in chunk[p - n : p][::-1]]
            p -= n
        return np.array(out[::-1], np.int32), len(out)

    def _solve(self, chunks: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, width = len(chunks), int(lengths.max()) if len(chunks) else 0
        if not width:
            return np.empty(0, np.int32), np.zeros(m, np.int64)
        text = np.zeros((width, m), np.uint8)
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        row = np.repeat(np.arange(m), lengths)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
        best = np.full((width + 1, m), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, m), np.int32)
        last = np.full((width + 1, m), -1, np.int32)  # -1: a character in bytes
        size = np.ones(256, np.int64)
        size[0xC0:], size[0xE0:], size[0xF0:] = 2, 3, 4
        for s in range(width):
            rows = np.flatnonzero((best[s] > -np.inf) & (lengths > s))
            if not len(rows):
                continue
            char = np.minimum(size[text[s, rows]], lengths[rows] - s)
            alone = np.zeros(m, bool)
            chars = np.zeros(m, np.int64)
            chars[rows] = char
            first, node = rows, np.zeros(len(rows), np.int32)
            for e in range(s, min(width, s + self.longest)):
                if e > s:
                    ok = lengths[rows] > e
                    rows, node = rows[ok], node[ok]
                nxt = self.base[node] + text[e, rows]
                ok = self.check[nxt] == node
                rows, node = rows[ok], nxt[ok]
                if not len(rows):
                    break
                k = self.piece[node]
                hit = k >= 0
                r, k = rows[hit], k[hit]
                alone[r[chars[r] == e + 1 - s]] = True
                new = best[s, r] + self.score[k]
                ok = new > best[e + 1, r]
                r = r[ok]
                best[e + 1, r], back[e + 1, r], last[e + 1, r] = new[ok], s, k[ok]
            r = first[~alone[first]]
            e = s + chars[r]
            new = best[s, r] + self.unknown
            ok = new > best[e, r]
            r, e = r[ok], e[ok]
            best[e, r], back[e, r], last[e, r] = new[ok], s, -1
        rows, at = np.arange(m), lengths.copy()
        found = []
        while True:  # all paths back at once
            ok = at > 0
            rows, at = rows[ok], at[ok]
            if not len(rows):
                break
            start, k = back[at, rows].astype(np.int64), last[at, rows]
            found.append((rows[k >= 0], start[k >= 0], k[k >= 0]))
            raw = np.flatnonzero(k < 0)
            for d in range(4):
                r = raw[at[raw] - start[raw] > d]
                if len(r):
                    found.append((rows[r], start[r] + d, self.byte[text[start[r] + d, rows[r]]]))
            at = start
        r, p, k = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((p, r))
        return k[order].astype(np.int32), np.bincount(r, minlength=m)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; null and empty texts have none."""
        seen: dict[bytes, int] = {}
        put = seen.setdefault
        flow: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        mark = MARK.encode()
        for k, t in enumerate(texts):
            if not t:
                continue
            n = len(flow)
            for line, part in enumerate(t.encode("utf-8", "replace").replace(mark, _RAW).replace(b" ", mark).split(b"\n")):
                if line:
                    flow.append(put(b"\n", len(seen)))
                else:
                    part = mark + part
                for raw, own in enumerate(part.split(_RAW)):
                    if raw:
                        flow.append(put(_RAW, len(seen)))
                    words = own.split(mark)
                    if words[0]:
                        flow.append(put(words[0], len(seen)))
                    blank = mark
                    for w in words[1:-1]:
                        if w:
                            flow.append(put(blank + w, len(seen)))
                            blank = mark
                        else:
                            blank += mark
                    if len(words) > 1:
                        flow.append(put(blank + words[-1], len(seen)))
            counts[k] = len(flow) - n
        ids, each = self.solve(list(seen))
        if _RAW in seen:  # the character that markers look like comes as its bytes, so that it isn't read as a blank
            j = seen[_RAW]
            at = int(each[:j].sum())
            ids = np.concatenate((ids[:at], self.byte[list(mark)], ids[at + each[j] :]))
            each[j] = len(mark)
        starts = np.cumsum(each) - each
        path = np.array(flow, np.int64)
        num = each[path]
        place = np.repeat(starts[path] - (np.cumsum(num) - num), num) + np.arange(num.sum())
        ends = np.cumsum(np.concatenate(([0], num)))
        cut = np.cumsum(np.concatenate(([0], counts)))
        return ids[place], np.diff(ends[cut])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of id sequences: bytes are joined, markers are spaces, the leading one goes."""
        num = self.out_len[ids]
        body = self.out[np.repeat(self.out_at[ids] - (np.cumsum(num) - num), num) + np.arange(num.sum())].tobytes()
        ends = np.cumsum(np.concatenate(([0], num)))[np.cumsum(np.concatenate(([0], counts)))].tolist()
        out = []
        for s, e in zip(ends, ends[1:]):  # noqa: B905
            t = body[s:e].decode("utf-8", "replace")
            out.append(t[1:] if t.startswith(" ") else t)
        return out


def _groups(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of a batch with about so many characters, or one text."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t.as_py() or ())
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, *, text_col: str = "text", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with ids_col, array<int>: the ids of the whole text's best segmentation.

    Line feeds, U+2581 and other characters that no piece covers come as byte pieces, so that any text comes
    back from its ids. A null text has null ids, an empty one none; repeated rows have equal ids. Of paths
    with equal scores the one whose last piece is longer wins at each place. Texts of any length are solved
    chunk by chunk. An empty table gives no rows. Other columns stay; ids_col must be new.
    """
    if ids_col in docs.columns:
        raise ValueError(f"documents already have {ids_col}")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))  # of the model's size
    schema = T.StructType([*docs.schema, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            texts = batch.column(text_col)
            for s, e in _groups(texts):
                part = batch.slice(s, e - s)
                own = part.column(text_col)
                ids, counts = v.encode(own.to_pylist())
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32(), mask=np.append(own.is_null().to_numpy(zero_copy_only=False), False))
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(ends, pa.array(ids))], names=[*batch.schema.names, ids_col])

    small_batches(docs.sparkSession)
    return mapped(docs, run, schema)


def decode(docs: DataFrame, *, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with text_col, what ids_col spells; null ids give null. Bytes that aren't UTF-8 show as U+FFFD."""
    if text_col in docs.columns:
        raise ValueError(f"documents already have {text_col}")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))
    schema = T.StructType([*docs.schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            col = batch.column(ids_col)
            gone = col.is_null().to_numpy(zero_copy_only=False)
            counts = np.where(gone, 0, col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts = []
            for s in range(0, len(col), 500):
                part = col.slice(s, 500).flatten().to_numpy(zero_copy_only=False)
                texts += v.decode(part, counts[s : s + 500])
            yield pa.record_batch([*batch.columns, pa.array([None if g else t for g, t in zip(gone, texts, strict=True)], pa.string())], names=[*batch.schema.names, text_col])

    small_batches(docs.sparkSession)
    return mapped(docs, run, schema)
