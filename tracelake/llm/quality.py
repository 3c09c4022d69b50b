"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled 1; the other sample is unlabelled web text, whose labels are never
looked at. The class prior is estimated from the two samples alone, and a small network is fitted in numpy
under the non-negative unbiased risk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import held_out, mapped, small_batches
from tracelake.llm.samples import labelled, unlabelled

_CLASSES = 12
_BLOCK = 256


def _table() -> np.ndarray:
    out = np.full(256, 11, np.uint8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"#$%&*@^~=+", b"|<>/\\_{}[]")):
        out[list(chars)] = k
    out[0x80:] = 9
    out[list(b"'\"()-`")] = 10
    return out


_KIND = _table()
WIDTH = _CLASSES * _CLASSES + _CLASSES + 10


def features(text: str | None) -> np.ndarray:
    """A whole text as numbers: neighbouring kinds of bytes, the worst block for each kind, repetition."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    kinds = _KIND[np.frombuffer(raw, np.uint8)].astype(np.int64)
    n = len(kinds)
    if n > 1:
        out[: _CLASSES**2] = np.sqrt(np.bincount(kinds[1:] + _CLASSES * kinds[:-1], minlength=_CLASSES**2) / (n - 1))
    blocks = max(1, n // _BLOCK)
    at = np.minimum(np.arange(n) // _BLOCK, blocks - 1)
    table = np.bincount(at * _CLASSES + kinds, minlength=blocks * _CLASSES).reshape(blocks, _CLASSES)
    out[_CLASSES**2 : _CLASSES**2 + _CLASSES] = (table / table.sum(axis=1, keepdims=True)).max(axis=0)
    words = raw.split()
    m = len(words)
    if m:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lines = [x for x in raw.split(b"\n") if x.strip()]
        same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, m - 1)  # noqa: B905
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0])))).reshape(-1, 2)
        run = int((edges[:, 1] - edges[:, 0]).max()) if len(edges) else 0
        out[-10:] = (np.log1p(m) / 10, len(counts) / m, max(counts.values()) / m, same.mean() if m > 1 else 0, min(run, 20) / 20, len(set(lines)) / len(lines), np.log1p(len(lines)) / 10, min(n / m, 40) / 40, np.log1p(n / len(lines)) / 10, 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Net:
    """One hidden layer; ``fit`` takes the gradient of the risk at each output."""

    def __init__(self, width: int, hidden: int, rng: np.random.Generator) -> None:
        self.p = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.m = [np.zeros_like(x) for x in self.p]
        self.v = [np.zeros_like(x) for x in self.p]
        self.t = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        self.x, self.h = x, np.tanh(x @ self.p[0] + self.p[1])
        return self.h @ self.p[2] + self.p[3][0]

    def step(self, g: np.ndarray, rate: float, decay: float) -> None:
        gh = g[:, None] * self.p[2] * (1 - self.h**2)
        grads = [self.x.T @ gh + decay * self.p[0], gh.sum(axis=0), self.h.T @ g + decay * self.p[2], np.array([g.sum()])]
        self.t += 1
        for p, m, v, d in zip(self.p, self.m, self.v, grads, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def class_prior(positive: np.ndarray, unlabelled_: np.ndarray) -> float:
    """The share of positives among unlabelled scores: the smallest ratio of the tails above a threshold.

    Above a threshold that few negatives pass, unlabelled mass is the prior times positive mass. A term for
    sampling error keeps thresholds with little mass from winning.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled_ >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled_)))
    k = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[k] / p[k], 0.05, 0.98))


def train(positive: np.ndarray, unlabelled_: np.ndarray, *, prior: float | None = None, hidden: int = 32, steps: int = 900, seed: int = 0) -> dict:
    """A model from feature rows of trusted positives and of unlabelled text."""
    rng = np.random.default_rng(seed)
    every = np.concatenate((positive, unlabelled_))
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-2
    xp, xu = (positive - mean) / scale, (unlabelled_ - mean) / scale
    xp, xu = np.clip(xp, -6, 6), np.clip(xu, -6, 6)

    def run(pi: float | None) -> Net:
        net = Net(every.shape[1], hidden, rng)
        for k in range(steps if pi else steps // 3):
            a, b = xp[rng.integers(0, len(xp), 512)], xu[rng.integers(0, len(xu), 1024)]
            z = net(np.concatenate((a, b)))
            zp, zu = z[:512], z[512:]
            if pi is None:  # tell the samples apart; only the order of its scores is used
                g = np.concatenate(((_sigmoid(zp) - 1) / 512, _sigmoid(zu) / 1024))
            else:
                rest = np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()
                if rest >= 0:  # pi E+[l(g)] + (Eu[l(-g)] - pi E+[l(-g)])
                    g = np.concatenate((pi * ((_sigmoid(zp) - 1) - _sigmoid(zp)) / 512, _sigmoid(zu) / 1024))
                else:  # walk back what overfits
                    g = np.concatenate((pi * _sigmoid(zp) / 512, -_sigmoid(zu) / 1024))
            net.step(g, 0.01 if k < steps * 2 // 3 else 0.002, 1e-4)
        return net

    if prior is None:
        first = run(None)
        prior = class_prior(first(xp), first(xu))
    net = run(prior)
    return {"mean": mean, "scale": scale, "params": [x.astype(np.float64) for x in net.p], "prior": prior}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    w, b, v, c = model["params"]
    x = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return _sigmoid(np.tanh(x @ w + b) @ v + c[0])


def _featured(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([features(t.as_py()).tobytes() for t in batch.column(0)], pa.binary())], names=["x"])

    small_batches(docs.sparkSession)
    return mapped(docs.select(F.col(text_col).cast("string")), run, "x binary")


def _matrix(df: DataFrame) -> np.ndarray:
    rows = df.toArrow().column(0).to_pylist()
    return np.frombuffer(b"".join(sorted(rows)), np.float32).reshape(-1, WIDTH).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = 8000, web: int = 12000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> dict | None:
    """A model from at most ``positives`` trusted ids and ``web`` unlabelled ones, none held out.

    Only features, of a fixed width, come to the driver. None without any positive or any text to learn from.
    """
    xp = _matrix(_featured(labelled(docs, labels, label, each=positives, id_col=id_col, only=(1,)).select("doc.*"), text_col))
    xu = _matrix(_featured(unlabelled(docs, n=web, id_col=id_col), text_col))
    return train(xp, xu) if len(xp) and len(xu) else None


def scored(docs: DataFrame, model: dict | None, *, text_col: str = "text", threshold: float = 0.3, score_col: str = "score", label_col: str = "predicted") -> DataFrame:
    """``docs`` with score_col (0 to 1) and label_col (1 if the score is at least ``threshold``).

    Null and empty texts have all features zero and are scored like others; without a model every score is
    0.5. Repeated rows score alike. Other columns stay; score_col and label_col must not be among them.
    """
    if clash := {score_col, label_col} & set(docs.columns):
        raise ValueError(f"documents already have {sorted(clash)}")
    schema = T.StructType([*docs.schema, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(text_col).to_pylist()]
            s = predict(model, np.array(x, np.float64).reshape(-1, WIDTH)) if model else np.full(len(x), 0.5)
            yield pa.record_batch([*batch.columns, pa.array(s)], names=[*batch.schema.names, score_col])

    small_batches(docs.sparkSession)
    return mapped(docs, run, schema).withColumn(label_col, (F.col(score_col) >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; learned from the folds that aren't held out."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    out = scored(docs.select(id_col, text_col), model, text_col=text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
