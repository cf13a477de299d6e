"""Quality scores by naive Bayes support vectors.

Features are indicators of hashed word n-grams, of n-grams of word shapes (classes of a word's outer characters, its
length, whether it repeats one of the two words before) and of the bins of a text's distinct-word shares. Indicators are
scaled by the classes' log-count ratios; a linear hinge-loss model is then fitted to them by dual coordinate descent, and
its margins are turned into probabilities by a sigmoid fitted on rows that the descent has not seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, smallest
from .words import hashed_bytes, mix

BITS = 18
_BREAKS = bytes(32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))


def _classes() -> np.ndarray:
    """Lower-case and other letters 0, capitals 1, digits 2, then each ASCII sign by itself."""
    out = np.zeros(256, np.uint64)
    signs = 3
    for c in range(33, 127):
        if chr(c).isupper():
            out[c] = 1
        elif chr(c).isdigit():
            out[c] = 2
        elif not chr(c).isalpha():
            out[c] = signs
            signs += 1
    return out


_CLASS = _classes()


def _owned(h: np.ndarray, own: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams that don't cross texts, and their texts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.full(m, salt, np.uint64)
    for k in range(n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    inside = own[:m] == own[n - 1 :]
    return mix(s[inside]), own[:m][inside]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of all texts, one text after another, and where each text's begin; every text has some."""
    coded = [(t or "").encode("utf-8", "replace").translate(_BREAKS) for t in texts]
    a = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    letter = np.concatenate(([False], a != 32, [False]))
    starts = np.flatnonzero(letter[1:-1] & ~letter[:-2])
    ends = np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded]))))
    n = len(texts)
    own = np.repeat(np.arange(n), np.diff(bounds))
    words = hashed_bytes(a, starts, ends)
    last = ends - 1
    size = np.minimum(ends - starts, 12).astype(np.uint64)
    again = np.zeros(len(words), np.uint64)
    for k in (1, 2):
        again[k:] |= (words[k:] == words[:-k]) & (own[k:] == own[:-k])
    shape = _CLASS[a[starts]] | _CLASS[a[last]] << np.uint64(6) | _CLASS[a[np.maximum(starts, last - 1)]] << np.uint64(12) | (size > 9).astype(np.uint64) << np.uint64(18) | again << np.uint64(19)
    keys, texts_of = [], []
    shares = []
    for k, salt in ((1, 11), (2, 12)):
        h, o = _owned(words, own, k, salt)
        pair = np.unique(o.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))  # 44 bits tell a text's n-grams apart
        keys.append(mix(pair & np.uint64((1 << 44) - 1)) & np.uint64((1 << BITS) - 1))
        texts_of.append((pair >> np.uint64(44)).astype(np.int64))
        total = np.maximum(np.bincount(o, minlength=n), 1)
        shares.append(np.bincount(texts_of[-1], minlength=n) / total)
    for k, salt in ((1, 21), (2, 22), (3, 23)):
        h, o = _owned(shape, own, k, salt)
        keys.append(h & np.uint64((1 << BITS) - 1))
        texts_of.append(o)
    log_size = np.floor(np.log2(np.diff(bounds) + 1)).astype(np.uint64)
    for k, share in enumerate(shares):
        bin_ = np.floor(share * 20).astype(np.uint64)
        for salt, value in ((31 + k, bin_), (41 + k, bin_ * np.uint64(64) + log_size)):
            keys.append(mix(value + np.uint64(salt << 32)) & np.uint64((1 << BITS) - 1))
            texts_of.append(np.arange(n))
    both = np.unique(np.concatenate(texts_of).astype(np.uint64) << np.uint64(BITS) | np.concatenate(keys))
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> np.uint64(BITS), np.arange(n + 1, dtype=np.uint64))


@dataclass
class Model:
    """weights of the indicators (ratios included); the score is a sigmoid of slope x (weights . indicators / sqrt(their number)) + offset."""

    weights: np.ndarray
    slope: float
    offset: float

    def margins(self, f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[f])))
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.sqrt(np.maximum(np.diff(bounds), 1))

    def scores(self, texts: list) -> np.ndarray:
        z = self.slope * self.margins(*features(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float) -> np.ndarray:
    p, q = (np.full(1 << BITS, alpha) for _ in range(2))
    for f, label in zip(rows, y, strict=True):
        (p if label else q)[f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, rng) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum of cost x hinge loss, by coordinate descent on the dual."""
    w, alpha = np.zeros(1 << BITS), np.zeros(len(rows))
    norm = np.array([float(v @ v) for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            g = y[i] * float(values[i] @ w[rows[i]]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, cost: float = 1.0, epochs: int = 20, seed: int = 13) -> Model:
    """A model from rows of features and their labels (True is good). Of one class alone it scores everything alike."""
    y = labels.astype(bool)
    if not len(y) or y.all() or not y.any():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS), 1.0, math.log(rate / (1 - rate)))
    rng = np.random.default_rng(seed)
    own = rng.random(len(rows)) < 0.8
    if y[own].all() or not y[own].any() or own.all():
        own[:] = True
    part = [f for f, o in zip(rows, own, strict=True) if o]
    r = _ratios(part, y[own], alpha)
    values = [r[f] / math.sqrt(max(1, len(f))) for f in part]
    sign = np.where(y[own], 1.0, -1.0)
    rate = y[own].mean()
    w = _descent(part, values, sign, np.where(y[own], cost / (2 * rate), cost / (2 * (1 - rate))), epochs, rng) * r
    rest = ~own if (~own).any() else own
    test = [f for f, o in zip(rows, rest, strict=True) if o]
    x = np.array([w[f].sum() / math.sqrt(max(1, len(f))) for f in test])
    t = np.where(y[rest], (y[rest].sum() + 1) / (y[rest].sum() + 2), 1 / ((~y[rest]).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method on the two parameters of the sigmoid
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - max(-2, min(2, step[0])), b - max(-2, min(2, step[1]))
        if abs(step).max() < 1e-8:
            break
    return Model(w, float(a), float(b))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 8000) -> Model:
    """A model from at most `most` labelled rows that are not held out, those with the smallest hash of their id; the bound on what the driver fits."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    sample = smallest(marks, ["doc_id"], most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("__quality").alias("quality"))

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1):
                f, bounds = features(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary())], names=["quality", "features"])

    got = rows.select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "quality int, features binary").collect()
    got.sort(key=lambda r: (r["quality"], bytes(r["features"])))
    return fit([np.frombuffer(r["features"], np.int32) for r in got], np.array([r["quality"] == 1 for r in got], bool))


def classify(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document; score is the probability of quality 1.

    Null texts are empty; empty texts are scored by their shares' bins. Null doc_ids are not held out; repeated rows are
    scored alike. Without labels of both kinds all rows score the labelled rows' rate (0.5 of none). An empty table gives
    an empty table. Only column text is scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 2):
                s = shared.value.scores(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
