"""Operator 2: quality by a byte-level convolutional network, trained in numpy.

FILTERS learned filters of WIDTH bytes slide over every byte of a document.  The
rectified filter values are max-pooled over chunks of 2 HOP bytes that overlap
by half and cover the whole document; the mean and the maximum over its chunks
of each filter go into a logistic layer that gives one probability of good
quality.  Training takes a bounded sample of labelled documents
(tables.SAMPLE_ROWS; of long ones windows from start to end, tables.SAMPLE_CHARS).
A quarter of it calibrates the threshold: a good document lost counts GOOD_WEIGHT
times as much as a bad one kept, by shares of either class, and the threshold is in
the middle of the best range.

Defined cases: a null or empty text has probability 0 and is rejected.  If the
labels lack one of the classes, nothing else is rejected (probability 1); if only
the calibrating quarter does, the threshold is 0.5.  A probability equal to the
threshold is good.  Rows are scored one by one, repeated ones alike; a text of any
length is read to its end, BLOCK bytes at a time.  doc_id has to be a number or null
for the scores; other columns, whatever their names, are ignored by the scores and
kept by the filter.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .tables import SAMPLE_ROWS, labelled_sample

WIDTH, FILTERS, HOP = 5, 8, 256
EPOCHS, BATCH, RATE, SEED = 6, 16, 0.02, 29
GOOD_WEIGHT = 20
#: Bytes that are scored at a time.
BLOCK = 1 << 17


@dataclass
class Model:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    biases: np.ndarray
    weights: np.ndarray  # (2 * FILTERS,): of means, of maxima
    bias: float
    threshold: float = 0.5
    fitted: bool = True

    def values(self, data: np.ndarray) -> np.ndarray:
        """Filter values at each byte of data that has WIDTH - 1 bytes behind it."""
        n = len(data) - WIDTH + 1
        z = self.filters[0][data[:n]]
        for j in range(1, WIDTH):
            z += self.filters[j][data[j : j + n]]
        return z

    def features(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Means and maxima over the chunks of rows that aren't empty."""
        rows = len(off) - 1
        size = np.diff(off)
        gap = WIDTH - 1
        data = np.zeros(len(raw) + gap * rows, np.uint8)
        place = off[:-1] + gap * np.arange(rows)
        for k in range(rows):
            data[place[k] : place[k] + size[k]] = raw[off[k] : off[k + 1]]
        z = self.values(np.append(data, np.zeros(gap, np.uint8)))
        pad = (place + size)[:, None] + np.arange(gap)[None, :]
        z[pad.ravel()] = -np.inf
        halves = -(-size // HOP)
        first = np.concatenate([[0], np.cumsum(halves)])
        starts = np.repeat(place - HOP * first[:-1], halves) + HOP * np.arange(first[-1])
        return self.pooled(np.maximum.reduceat(z, starts, axis=0), halves)

    def features_of_one(self, raw: np.ndarray) -> np.ndarray:
        """features() of one row, of which no more than BLOCK bytes are looked at together."""
        data, top = np.append(raw, np.zeros(WIDTH - 1, np.uint8)), []
        for at in range(0, len(raw), BLOCK):
            z = self.values(data[at : at + BLOCK + WIDTH - 1])
            top.append(np.maximum.reduceat(z, np.arange(0, len(z), HOP), axis=0))
        return self.pooled(np.concatenate(top), np.array([-(-len(raw) // HOP)]))

    def pooled(self, top: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Features from the maxima of each HOP bytes; halves: how many of these each row has."""
        top = np.maximum(top + self.biases, 0)
        first = np.concatenate([[0], np.cumsum(halves)])
        pair = np.maximum(top[:-1], top[1:]) if len(top) > 1 else top[:0]
        chunk = np.concatenate([pair, top[-1:]])  # chunk h is halves h and h + 1
        last = first[1:] - 1
        alone = halves == 1
        chunk[last[alone]] = top[last[alone]]
        chunk[last[~alone]] = top[last[~alone]]  # inside the chunk before it: changes no maximum and is left out of the mean
        sums = np.add.reduceat(chunk, first[:-1], axis=0)
        many = np.where(alone, 1, halves - 1)
        sums[~alone] -= chunk[last[~alone]]
        return np.hstack([sums / many[:, None], np.maximum.reduceat(chunk, first[:-1], axis=0)]).astype(np.float64)

    def probabilities(self, col: pa.Array) -> np.ndarray:
        raw, off = tk.buffers(pc.fill_null(col, ""))
        size = np.diff(off)
        p = np.zeros(len(size))
        full = np.flatnonzero(size > 0)
        if not self.fitted:
            p[full] = 1
        elif len(full):
            if len(full) == 1 and len(raw) > BLOCK:
                x = self.features_of_one(raw)
            else:
                x = self.features(raw, np.concatenate([[0], np.cumsum(size[full])]))
            p[full] = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -700, 700)))
        return np.round(p, 6)


def train(docs: list[tuple[np.ndarray, int]], seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """docs: bytes and class of each document.  Adam over batches."""
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), 0.0)
    docs = [d for d in docs if len(d[0])]
    share = np.mean([y for _, y in docs]) if docs else 0
    if not 0 < share < 1:
        m.fitted = False
        return m
    params = [m.filters, m.biases, m.weights, np.zeros(1)]
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in params]
    cols = np.arange(FILTERS)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for begin in range(0, len(order), BATCH):
            grads = [np.zeros(p.shape) for p in params]
            for k in order[begin : begin + BATCH]:
                data, y = docs[k]
                n = len(data)
                data = np.append(data, np.zeros(WIDTH - 1, np.uint8))
                halves = -(-n // HOP)
                z = np.full((halves * HOP, FILTERS), -np.inf, np.float32)
                z[:n] = m.values(data)
                z = z.reshape(halves, HOP, FILTERS)
                best = z.argmax(axis=1)
                top = np.take_along_axis(z, best[:, None, :], axis=1)[:, 0, :]
                best = best + (HOP * np.arange(halves))[:, None]
                if halves > 1:
                    right = top[1:] > top[:-1]
                    top, best = np.where(right, top[1:], top[:-1]), np.where(right, best[1:], best[:-1])
                act = np.maximum(top + m.biases, 0)
                far = act.argmax(axis=0)
                x = np.concatenate([act.mean(axis=0), act[far, cols]])
                p = 1 / (1 + np.exp(-np.clip(x @ m.weights + params[3][0], -30, 30)))
                d = (p - y) / (2 * share if y else 2 * (1 - share)) / BATCH
                grads[2] += d * x
                grads[3] += d
                back = np.repeat((d * m.weights[:FILTERS] / len(act))[None, :], len(act), axis=0)
                back[far, cols] += d * m.weights[FILTERS:]
                back *= act > 0
                grads[1] += back.sum(axis=0)
                for j in range(WIDTH):
                    spot = data[best + j].astype(np.int64) * FILTERS + cols
                    grads[0][j] += np.bincount(spot.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            rate = RATE / (1 + epoch)
            for p, g, (a, b) in zip(params, grads, moments):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    m.bias = float(params[3][0])
    m.biases = m.biases.astype(np.float32)
    return m


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Rows from the threshold on are kept."""
    if not 0 < y.sum() < len(y):
        return 0.5
    cuts = np.unique(np.append(p, 1.0))  # keeps what is at or above
    lost = np.searchsorted(np.sort(p[y == 1]), cuts) / y.sum()
    kept = 1 - np.searchsorted(np.sort(p[y == 0]), cuts) / (1 - y).sum()
    cost = GOOD_WEIGHT * lost + kept
    k = int(np.argmin(cost))
    low = cuts[k - 1] if k else 0.0
    return float((low + cuts[k]) / 2)


def fit(sample: list) -> Model:
    """sample: rows (doc_id, text, lang, y)."""
    sample = sorted(sample, key=lambda r: r.doc_id)
    held = np.arange(len(sample)) % 4 == 3
    m = train([(np.frombuffer(r.text.encode(), np.uint8), r.y) for r, h in zip(sample, held) if not h])
    kept = [r for r, h in zip(sample, held) if h and r.text]
    if m.fitted and kept:
        p = np.concatenate([m.probabilities(pa.array([r.text])) for r in kept])
        m.threshold = best_threshold(p, np.array([r.y for r in kept]))
    return m


def scored(docs: DataFrame, model: Model, keep: bool = False, column: str = "") -> DataFrame:
    """(doc_id, quality, good) for every document; with ``keep`` the good documents' own columns, with ``column`` all documents with their probability in it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for s in tk.slices(batch, "text", BLOCK):
                yield s, shared.value.probabilities(s.column("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, p in pieces(batches):
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(p), pa.array((p > 0) & (p >= shared.value.threshold))], ["doc_id", "quality", "good"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, p in pieces(batches):
            yield s.filter(pa.array((p > 0) & (p >= shared.value.threshold)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, p in pieces(batches):
            yield pa.RecordBatch.from_arrays([*s.columns, pa.array(p)], [*s.schema.names, column])

    if keep:
        return docs.mapInArrow(select, docs.schema)
    if column:
        return docs.mapInArrow(rate, T.StructType([*docs.schema, T.StructField(column, T.DoubleType())]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, quality double, good boolean")


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return scored(docs, fit(labelled_sample(docs, labels, "quality", rows).collect()))


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    return scored(docs, fit(labelled_sample(docs, labels, "quality", rows).collect()), keep=True)


def rated(docs: DataFrame, column: str, documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with one more column, their probability of good quality by a model of labelled ``documents``."""
    return scored(docs, fit(labelled_sample(documents, labels, "quality", rows).collect()), column=column)
