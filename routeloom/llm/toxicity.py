"""Operator 1: toxicity by a convolutional text classifier, trained in numpy.

Words are hashed into 2 ** BITS buckets.  Every bucket that the sample has gets an
embedding, shrunk by how few of its documents have the word (RARE), so that the words
of single documents are hardly learnt by heart; in training some words are dropped.
Words that the sample hasn't are zeros.  Filters of widths 1, 2 and 3 slide over the
embeddings of a document, each is max-pooled over all of it, and a logistic layer
combines the rectified maxima.  Training takes a bounded sample of labelled documents
(SAMPLE_ROWS; of long ones windows from start to end, tables.SAMPLE_CHARS), near copies
within it once.  Thresholds are calibrated on all of the sample by cross-fitting: for
each language the middle of the widest range of scores that gives the best F1, averaged
(by logits) with that of all languages together by the number of its documents.

To score, filters are folded into the embeddings: a filter's value at a word is
a sum of table rows, so that whole Arrow slices are scored by lookups.

Defined cases: a text without words (null or empty, too) has score 0 and isn't
toxic.  A null language, or one without labelled documents of both classes, has the
common threshold.  If the labels lack one of the classes (or are empty), all scores are
0 and nothing is toxic; if a class has a single document, thresholds are 0.5.  Scores
equal to the threshold are toxic.  Rows are scored one by one, whole texts of any
length, repeated rows alike; doc_id has to be a number or null; other columns are
ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import labelled_sample

BITS, DIM, WIDTHS, FILTERS = 22, 12, (1, 2, 3), 6
#: Labelled documents in the sample, at most.
SAMPLE_ROWS = 8000
#: Words of a long text that are scored at a time.
PIECE, GAP = 1 << 18, max(WIDTHS) - 1
#: A word of d sampled documents has d / (d + RARE) of its embedding, in training too: what few documents say is drawn towards nothing.
RARE, PRIOR = 10.0, 10.0
EPOCHS, BATCH, RATE, DROP, START, SEED = 3, 32, 0.1, 0.05, 0.02, 13
#: Documents of either class that a language's own threshold is weighed against.
SHRINK = 20


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    known: np.ndarray  # buckets that have an embedding, sorted
    embeddings: np.ndarray  # (len(known) + 1, DIM); the last row is for other words and pads
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    biases: np.ndarray  # (all filters,)
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 1.0
    fitted: bool = True

    def lookup(self) -> np.ndarray:
        """The embedding's row of each bucket."""
        rows = np.full(1 << BITS, len(self.known), np.int32)
        rows[self.known] = np.arange(len(self.known))
        return rows

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embeddings @ w[j]).astype(np.float32) for j in range(len(w))] for w in self.filters]

    def logits(self, words: tk.Tokens, lookup: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """One for each row; minus infinity for rows without words."""
        n = len(words.rows) - 1
        sizes = np.diff(words.rows)
        out = np.full(n, -np.inf)
        full = np.flatnonzero(sizes > 0)
        if not len(full) or not self.fitted:
            return out
        if len(full) == 1:  # in pieces, as it may be very long
            ids = np.append(lookup[buckets(words.hashes)], [len(self.known)] * GAP)
            top = np.max([self.maxima(ids[k : k + PIECE + GAP], tables, np.zeros(1, int), GAP) for k in range(0, len(ids) - GAP, PIECE)], axis=0)
        else:
            first = words.rows[full] + GAP * np.arange(len(full))
            ids = np.full(len(words.hashes) + GAP * len(full), len(self.known), np.int32)
            real = np.arange(len(words.hashes)) + np.repeat(GAP * np.arange(len(full)), sizes[full])
            ids[real] = lookup[buckets(words.hashes)]
            pad = np.ones(len(ids), bool)
            pad[real] = False
            top = self.maxima(ids, tables, first, pad)
        out[full] = self.bias + np.maximum(top + self.biases, 0) @ self.weights
        return out

    @staticmethod
    def maxima(ids: np.ndarray, tables: list[list[np.ndarray]], first: np.ndarray, pad: np.ndarray | int) -> np.ndarray:
        """Greatest value of each filter from each first position to the next; none begins at a pad (a mask, or how many at the end)."""
        out = []
        for own in tables:
            z = own[0][ids]
            for j in range(1, len(own)):
                z[:-j] += own[j][ids[j:]]
            if isinstance(pad, int):
                z = z[:-pad]
            else:
                z[pad] = -np.inf
            out.append(np.maximum.reduceat(z, first, axis=0))
        return np.hstack(out).astype(np.float64)


def without_near_copies(hashes: list[np.ndarray]) -> np.ndarray:
    """Whether each document shares neither of two least trigram hashes with one before it."""
    seen: tuple[set[int], set[int]] = (set(), set())
    out = np.ones(len(hashes), bool)
    for k, h in enumerate(hashes):
        if len(h):
            g = tk.ngrams(h, 3)
            keys = int(g.min()), int(tk.mix(g ^ tk.U64(SEED)).min())
            out[k] = not any(x in s for x, s in zip(keys, seen))
            for x, s in zip(keys, seen):
                s.add(x)
    return out


def vocabulary(docs: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, sorted, and in how many documents of each class (clean, toxic) each is."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for d, y in docs:
        counts[y, np.unique(d)] += 1
    known = np.flatnonzero(counts.any(axis=0))
    return known, counts[:, known]


def evidence(clean: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Logarithm of how much likelier than by chance a document with a word is toxic, as if the word had been in PRIOR more documents of both classes by chance."""
    return np.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - np.log(share / (1 - share))


def train(docs: list[tuple[np.ndarray, int]], seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """docs: word buckets and class of each document.  Adagrad over batches; the classes weigh the same."""
    rng = np.random.default_rng(seed)
    docs = [d for d in docs if len(d[0])]
    known, held = vocabulary(docs)
    n, gap = len(WIDTHS) * FILTERS, GAP
    share = np.mean([y for _, y in docs]) if docs else 0
    m = Model(known, np.zeros((len(known) + 1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(n), np.zeros(n), 0.0, fitted=bool(0 < share < 1))
    if not m.fitted:
        return m
    factor = np.append(held.sum(axis=0) / (held.sum(axis=0) + RARE), 0).astype(np.float32)[:, None] * (np.arange(DIM) > 0)
    e = rng.normal(0, START, m.embeddings.shape).astype(np.float32)
    # offsets j of all filters in one matrix each; a filter has nothing beyond its width
    wide = np.repeat(WIDTHS, FILTERS)[None, :] > np.arange(gap + 1)[:, None]
    c = rng.normal(0, 0.3, (gap + 1, DIM, n))
    c[:, 0] = np.abs(c[:, 0])
    c = (c * wide[:, None, :]).astype(np.float32)
    bias, weights, last = np.zeros(n), np.abs(rng.normal(0, 0.3, n)), 0.0
    ge, gc, gb, gw, gl = np.full(len(e), 1e-3, np.float32), np.full(c.shape, 1e-3, np.float32), np.full(n, 1e-3), np.full(n, 1e-3), 1e-3
    row = m.lookup()
    ids_of, y_of = [row[d] for d, _ in docs], np.array([y for _, y in docs], float)
    # what the other documents say of each word: a document's own label must not speak for its words
    said_of = [np.append(evidence(held[0, x] - (y == 0), held[1, x] - (y == 1), share), [0] * gap).astype(np.float32) for x, y in zip(ids_of, y_of)]
    pad = np.full(gap, len(known), np.int32)
    for epoch in range(epochs):
        rate = RATE / (1 + epoch)
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            ids = np.concatenate([x for k in own for x in (ids_of[k], pad)])
            ends = np.cumsum([len(ids_of[k]) + gap for k in own])
            dropped = rng.random(len(ids)) < DROP
            ids = np.where(dropped, len(known), ids)
            x = factor[ids] * e[ids]
            x[:, 0] = np.where(dropped, 0, np.concatenate([said_of[k] for k in own]))
            z = x @ c[0]
            for j in range(1, gap + 1):
                z[:-j] += x[j:] @ c[j]
            best = np.stack([a + z[a : b - gap].argmax(axis=0) for a, b in zip([0, *ends], ends)])
            top = np.take_along_axis(z, best, axis=0)
            act = np.maximum(top + bias, 0)
            y = y_of[own]
            p = 1 / (1 + np.exp(-np.clip(act @ weights + last, -30, 30)))
            d = (p - y) / np.where(y > 0, 2 * share, 2 * (1 - share))
            back = d[:, None] * weights * (act > 0)
            grad = d @ act + 1e-4 * len(own) * weights
            gw += grad * grad
            weights -= rate * grad / np.sqrt(gw)
            grad = d.sum()
            gl += grad * grad
            last -= rate * grad / np.sqrt(gl)
            grad = back.sum(axis=0)
            gb += grad * grad
            bias -= rate * grad / np.sqrt(gb)
            back = back.astype(np.float32)
            old = c.copy()
            for j in range(gap + 1):
                hit = ids[best + j]
                grad = np.einsum("bf,bfd->df", back, x[best + j]) * wide[j]
                gc[j] += grad * grad
                c[j] -= rate * grad / np.sqrt(gc[j])
                some = np.flatnonzero(((back != 0) & wide[j]).ravel())
                if len(some):
                    hit, move = hit.ravel()[some], (back[:, :, None] * old[j].T[None]).reshape(-1, DIM)[some] * factor[hit.ravel()[some]]
                    words, at_word = np.unique(hit, return_inverse=True)
                    total = np.zeros((len(words), DIM), np.float32)
                    np.add.at(total, at_word, move)
                    ge[words] += (total * total).mean(axis=1)
                    e[words] -= rate * total / np.sqrt(ge[words])[:, None]
    m.embeddings = factor * e
    m.embeddings[:-1, 0] = evidence(*held, share)
    m.filters = [np.stack([c[j][:, k * FILTERS : (k + 1) * FILTERS] for j in range(w)]) for k, w in enumerate(WIDTHS)]
    m.biases, m.weights, m.bias = bias, weights, float(last)
    return m


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the scores between which F1 is best (the widest such gap)."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    low = np.append(s[1:], 0.0)
    ok = (s > low) & (f1 >= f1[s > low].max() - 1e-12) if (s > low).any() else np.zeros(len(s), bool)
    if not ok.any():
        return 2.0
    k = np.flatnonzero(ok)[np.argmax((s - low)[ok])]
    return float((s[k] + low[k]) / 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def calibrated(m: Model, logits: np.ndarray, y: np.ndarray, lang: np.ndarray) -> None:
    """Sets the common threshold and each language's: its own best one, drawn towards the common one as by SHRINK documents of a class.

    The average is taken of logits; thresholds are probabilities.
    """
    at = lambda own, what: float(np.log(t / (1 - t)) if 0 < (t := best_threshold(sigmoid(own), what)) < 1 else 0.0)
    common = at(logits, y)
    m.threshold = float(sigmoid(common))
    for one in sorted(set(lang.tolist()) - {""}):
        of = lang == one
        n = min(y[of].sum(), (1 - y[of]).sum())
        if n:
            m.thresholds[one] = float(sigmoid((n * at(logits[of], y[of]) + SHRINK * common) / (n + SHRINK)))


def fit(sample: list) -> Model:
    """sample: rows (doc_id, text, lang, y), at best not held by the caller.

    Thresholds come from cross-fitted scores: each half of the sample (of either class) is scored by a network trained on the other one.
    """
    sample = sorted(sample, key=lambda r: r.doc_id)
    hashes = [x for k in range(0, len(sample), 200) for x in tk.tokens(pa.array([r.text for r in sample[k : k + 200]], pa.string())).each()]
    rows = [(buckets(h).astype(np.int32), r.y, r.lang or "") for r, h, k in zip(sample, hashes, without_near_copies(hashes)) if k and len(h)]
    docs, y, lang = [(b, y) for b, y, _ in rows], np.array([y for _, y, _ in rows], int), np.array([x for _, _, x in rows])
    del sample, hashes, rows
    m = train(docs)
    if not m.fitted:
        return m
    m.threshold = 0.5
    half = np.zeros(len(y), int)
    for side in (0, 1):
        half[y == side] = np.arange((y == side).sum()) % 2
    if min(y.sum(), (1 - y).sum()) > 1:
        logits = np.zeros(len(y))
        for side in (0, 1):
            other = train([d for d, h in zip(docs, half) if h != side])
            lookup, tables = other.lookup(), other.tables()
            for k in np.flatnonzero(half == side):
                words = tk.Tokens(docs[k][0].astype(tk.U64) << tk.U64(64 - BITS), np.array([0, len(docs[k][0])]))
                logits[k] = np.clip(other.logits(words, lookup, tables)[0], -30, 30)
        calibrated(m, logits, y, lang)
    return m


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score, threshold, toxic) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lookup, tables = m.lookup(), m.tables()
        for batch in batches:
            for s in tk.slices(batch, "text"):
                p = np.round(sigmoid(m.logits(tk.tokens(s.column("text")), lookup, tables)), 6)
                limit = np.array([m.thresholds.get(x, m.threshold) for x in s.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("lang"), pa.array(p), pa.array(limit), pa.array(p >= limit)], ["doc_id", "lang", "score", "threshold", "toxic"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text").mapInArrow(score, "doc_id long, lang string, score double, threshold double, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return scored(docs, fit(labelled_sample(docs, labels, "toxic", rows).collect()))
