"""Toxicity scores by a convolutional network over hashed words, trained in numpy.

A word's vector is the sum of two hashed rows, the word's and its first letters'. Filters of widths 1 to 3
slide over the whole text, their maxima go to one logistic unit. Only the maxima pass gradients back, so
training costs little more than the forward pass. Scores are calibrated for the classes' natural shares;
thresholds are also calibrated for each language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import held_out, small_batches
from tracelake.llm.samples import labelled, shares

ROWS, DEPTH, FILTERS, HEAD = 1 << 14, 16, 16, 5
WIDTHS = (1, 2, 3)
_COLS = [(w, j) for w in WIDTHS for j in range(w)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class _Ids(dict):
    """Rows of a word and of its head, as one number; kept for the words seen so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = zlib.crc32(word) % ROWS << 32 | ROWS + zlib.crc32(b"^" + word.decode("utf-8", "ignore")[:HEAD].encode()) % ROWS
        return out


_ids = _Ids()


def tokens(text: str | None) -> np.ndarray:
    """Two rows for each word of the whole text, n by 2; ASCII case and punctuation don't count."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    both = np.fromiter(map(_ids.__getitem__, words), np.int64, len(words))
    return np.stack((both >> 32, both & 0xFFFFFFFF), axis=1).astype(np.int32)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {
        "e": rng.normal(0, 0.3, (2 * ROWS + 1, DEPTH)).astype(np.float32),  # the last row pads
        "w": rng.normal(0, 1 / np.sqrt(DEPTH), (DEPTH, len(_COLS) * FILTERS)).astype(np.float32),
        "b": np.zeros(len(WIDTHS) * FILTERS, np.float32),
        "o": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        "c": np.zeros(1, np.float32),
    }


def _laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Token rows of several documents, each followed by padding as wide as a filter's rest; their starts."""
    pad = np.full((max(WIDTHS), 2), 2 * ROWS, np.int32)
    rows = np.concatenate([x for d in docs for x in (d, pad)])
    starts = np.cumsum([0] + [len(d) + len(pad) for d in docs])[:-1]
    return rows, starts


def _maps(m: dict, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = m["e"][rows[:, 0]] + m["e"][rows[:, 1]]
    y = x @ m["w"]
    n = len(rows) - max(WIDTHS) + 1
    out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
    col = 0
    for k, w in enumerate(WIDTHS):
        z = out[:, k * FILTERS : (k + 1) * FILTERS]
        z[:] = y[:n, col : col + FILTERS]
        for j in range(1, w):
            z += y[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS]
        col += w * FILTERS
    return x, out


def logits(m: dict, docs: list[np.ndarray], chunk: int = 1 << 14) -> np.ndarray:
    """The network's output for token rows; long documents go through in overlapping chunks."""
    out = np.empty(len(docs))
    k = 0
    while k < len(docs):
        to, size = k, 0
        while to < len(docs) and (to == k or size + len(docs[to]) <= chunk):
            size += len(docs[to]) + max(WIDTHS)
            to += 1
        rows, starts = _laid_out(docs[k:to])
        if len(rows) <= 4 * chunk:
            _, maps = _maps(m, rows)
            top = np.maximum.reduceat(maps, starts, axis=0)
        else:
            top = np.full((1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
            for s in range(0, len(rows) - max(WIDTHS) + 1, chunk):
                top = np.maximum(top, _maps(m, rows[s : s + chunk + max(WIDTHS) - 1])[1].max(axis=0))
        out[k:to] = np.maximum(top + m["b"], 0) @ m["o"] + m["c"][0]
        k = to
    return out


def train(docs: list[np.ndarray], y: np.ndarray, *, epochs: int = 4, least_steps: int = 400, rate: float = 0.01, batch: int = 64, drop: float = 0.2, seed: int = 0) -> dict:
    """The network's weights, by Adam on the logistic loss, over at least ``epochs`` and ``least_steps``.

    A share ``drop`` of the words is left out of each look at a document.
    """
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-least_steps * batch // max(1, len(docs))))
    m = _start(rng)
    m["e"][-1] = 0
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    t, k = 0, len(WIDTHS) * FILTERS
    for epoch in range(epochs):
        step_size = rate * (0.3 if epoch >= epochs * 3 // 4 else 1)
        order = rng.permutation(len(docs))
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            rows, starts = _laid_out([docs[i] for i in own])
            rows[rng.random(len(rows)) < drop] = 2 * ROWS
            x, maps = _maps(m, rows)
            ends = np.append(starts[1:], len(maps))
            at = np.stack([maps[a:b].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)])
            pool = np.maximum(np.take_along_axis(maps, at, axis=0) + m["b"], 0)
            z = pool @ m["o"] + m["c"][0]
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[own]).astype(np.float32) / len(own)
            g = {"o": pool.T @ d + 1e-4 * m["o"], "c": np.array([d.sum()], np.float32)}
            dp = d[:, None] * m["o"] * (pool > 0)
            g["b"] = dp.sum(axis=0)
            gw, ge = np.zeros_like(m["w"]), np.zeros_like(m["e"])
            for c, (w, j) in enumerate(_COLS):
                f = slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS)
                pos, grad = at[:, f] + j, dp[:, f]
                v = x[pos]  # documents, filters, depth
                gw[:, c * FILTERS : (c + 1) * FILTERS] = np.einsum("nfd,nf->df", v, grad)
                gx = (grad[:, :, None] * m["w"][:, c * FILTERS : (c + 1) * FILTERS].T[None]).reshape(-1, DEPTH)
                for side in (0, 1):
                    np.add.at(ge, rows[pos.ravel(), side], gx)
            ge[-1] = 0
            g |= {"w": gw, "e": ge}
            t += 1
            for name, v in m.items():
                first[name] += 0.1 * (g[name] - first[name])
                second[name] += 0.01 * (g[name] ** 2 - second[name])
                v -= step_size * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-7)
    assert all(len(v) and np.isfinite(v).all() for v in m.values()) and k == len(m["o"])
    return m


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds that fit ``y`` best, by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-6
        g = np.array([(r * z).sum() + 1e-2 * (a - 1), r.sum()])
        m = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(m, g)
        d *= min(1, 2 / max(1e-9, np.abs(d).max()))
        a, b = a - d[0], b - d[1]
    return (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best F1, midway between neighbouring scores; 0.5 without both classes."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    q, yy, w = p[order], y[order], weight[order]
    hit, said = np.cumsum(w * yy), np.cumsum(w)
    f1 = 2 * hit / (said + (w * yy).sum())
    f1[:-1][q[:-1] == q[1:]] = -1
    k = int(np.argmax(f1))
    return float((q[k] + (q[k + 1] if k + 1 < len(q) else 0)) / 2)


def fit(docs: DataFrame, labels: DataFrame, *, each: int = 5000, longest: int = 8192, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label: str = "toxic") -> dict | None:
    """The model from at most ``each`` ids of either class, none held out; None if a class is missing.

    Documents of more than ``longest`` words aren't learned from, only scored, so that what comes to the driver
    is bounded in words too. A fifth of the sample calibrates the scores and each language's threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [tokens(t.as_py()) for t in batch.column(3)]
            short = pa.array([len(x) <= longest for x in own])
            yield pa.record_batch([*batch.columns[:3], pa.array([x.tobytes() for x in own], pa.binary())], names=["id", "y", "lang", "x"]).filter(short)

    some = labelled(docs, labels, label, each=each, id_col=id_col)
    of = lambda c: F.col("doc")[c]
    some = some.select(of(id_col).cast("long").alias("id"), F.col("y"), of(lang_col).cast("string").alias("lang") if lang_col in docs.columns else F.lit(None).cast("string").alias("lang"), of(text_col).cast("string").alias("text"))
    rows = some.mapInArrow(run, "id long, y int, lang string, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    y = rows.column("y").to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return None
    x = [np.frombuffer(b, np.int32).reshape(-1, 2) for b in rows.column("x").to_pylist()]
    lang = np.array(rows.column("lang").to_pylist(), object)
    rest = np.array([zlib.crc32(str(i).encode()) // 5 % 5 == 0 for i in rows.column("id").to_pylist()])
    if len(np.unique(y[rest])) < 2 or len(np.unique(y[~rest])) < 2:
        rest = np.arange(len(y)) % 5 == 0
    m = train([d for d, r in zip(x, rest, strict=True) if not r], y[~rest])
    there = shares(labels, label, id_col)
    weight = np.where(y == 1, there.get(1, 1) / max(1, (y == 1).sum()), there.get(0, 1) / max(1, (y == 0).sum()))
    z = logits(m, [d for d, r in zip(x, rest, strict=True) if r])
    a, b = calibrate(z, y[rest], weight[rest])
    p = _sigmoid(a * z + b)
    m |= {"slope": a, "shift": b, "overall": best_threshold(p, y[rest], weight[rest])}
    m["languages"] = {k: best_threshold(p[lang[rest] == k], y[rest][lang[rest] == k], weight[rest][lang[rest] == k]) for k in sorted({v for v in lang if v is not None}) if (y[rest][lang[rest] == k] == 1).sum() >= 10}
    return m


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", threshold: float = 0.5, **bounds: int) -> DataFrame:
    """(id_col, held_out, score, predicted, lang_threshold, flagged) of every row.

    score never depends on the id, the language or any label of the row; predicted is score >= ``threshold``;
    flagged compares the score with the threshold of the row's language, where that could be calibrated, or
    else with the one for all. Null, empty and wordless texts get the score of a text without words;
    without a model every score is 0. Repeated rows score alike; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    cuts = (model or {}).get("languages", {})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for s in range(0, batch.num_rows, 500):
                texts = batch.column(2).slice(s, 500).to_pylist()
                if m:
                    out[s : s + 500] = _sigmoid(m["slope"] * logits(m, [tokens(t) for t in texts]) + m["shift"])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out)], names=[id_col, "lang", "score"])

    lang = F.col(lang_col).cast("string").alias("lang") if lang_col in docs.columns else F.lit(None).cast("string").alias("lang")
    out = docs.select(F.col(id_col).cast("long").alias(id_col), lang, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} long, lang string, score double")
    own = F.lit((model or {}).get("overall", 0.5))
    for k, v in cuts.items():
        own = F.when(F.col("lang") == k, F.lit(v)).otherwise(own)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), own.alias("lang_threshold"), (F.col("score") >= own).cast("int").alias("flagged"))
