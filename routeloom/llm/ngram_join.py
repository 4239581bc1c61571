"""Operator 8: exact self-join of documents on the Jaccard coefficient of their word n-grams.

Grams of all documents have one global order: rare first, by the number of documents
that have the gram (exact up to 200, in steps of a fifth beyond), then by hash.  A document of m grams is
indexed under its first ``m - ceil(t m) + 1`` grams (its prefix).  Documents that
share a prefix gram become a candidate pair if the length and positional filters
allow it; candidates are made distinct, cut by the suffix filter and verified once.
The suffix filter splits both gram sets (in the order of their hashes) at the medians of
one set's halves, quarters and eighths, which binary search finds in the other: what the
pieces differ in size, the sets differ in grams.  Counts in CELLS fixed cells are
compared before that, for many pairs at once.

The counts come from one exchange: every pack of documents sends its grams, five bytes
each, to parts by gram; a part counts its grams exactly and answers only for those that
two contents share.  Of a gram that COMMON or more documents of a pack have only their
number goes to its part, so that a gram of most documents doesn't fill one; the pack's
list of them goes along with its heads, to any part.  Grams of one content come first in
the order and can't meet anything, so a document whose prefix they fill drops out there,
and the shared grams alone give the overlap of a pair.  A packed gram keeps 40 bits of
its hash besides its part (of at least 12): documents of a and b grams have a wrong
common gram with a probability of at most a b / (12 * 2 ** 40), a pair of 10,000 words
each with one of 1 in 130,000.

Documents of equal token sequence ("copies") are one content while the join
runs.  ``similar_pairs`` lists each copy against the least doc_id of its content
(jaccard 1), and each similar pair of contents by their least doc_ids; all
other pairs follow from these, and the result stays linear in the copies.
``all_pairs`` lists them all.  ``classes``, the query, has one row a document instead: its class
(documents that are connected by similar ones), told by its least doc_id, and how many
documents are similar to it, copies counted each.  All candidate pairs of contents are verified
for that, but none leaves its task: rows and what is shuffled behind it grow with the documents.

Defined cases: null or empty texts, and texts without any letter or digit,
have no grams and no partners.  Texts shorter than n tokens are one gram; texts of any
length are compared whole.  A coefficient equal to the threshold is a match.
Rows with a null doc_id are left out, and other ids have to be numbers; rows that repeat
a doc_id with the same text count once; a doc_id with several texts is compared under each
of them, with a row for each of them, never with itself.  Other columns, whatever their
names, are ignored.  Empty tables give no rows.  For ``classes`` a document without grams
is a class of its own without links; a doc_id with several texts is one document, with the
links of each of its texts, to one another too, in one class with all that they are similar to.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import scratch, stored

N = 2
THRESHOLD = 0.6
#: Text bytes whose grams one part counts (a task needs some twenty times as much memory for a moment), and grams that a task
#: packs at a time.  These suit executors with MEMORY bytes of heap for each core; both grow with what a core has.
PART_BYTES, PACK, MEMORY = 8_000_000, 1_000_000, 900 << 20
#: Documents of a pack from which on a gram's documents aren't sent to be counted, but their number.
COMMON = 8
#: Bytes of postings that are joined by one task, candidate pairs that one verifies, and those of one label that one may get.
POSTINGS, PAIRS, TOGETHER = 24_000_000, 100_000, 1_000_000
#: Pairs that are made distinct at a time, and those of one label from which on overlaps are counted by bits, in so many cells at a time.
GATHERED, DENSE, BITS = 3_000_000, 16, 1 << 24
#: Cells of the histogram, and pieces of the suffix filter.
CELLS, PIECES = 32, 8
#: Bits of the filter by which sets of contents without candidates are kept from being shuffled: 16 a content, in slices.  Where
#: this isn't enough there is no filter; the join behind it is exact in any case.
FILTER_BITS, SLICES = 1 << 28, 64

U64 = np.uint64


def ceil_of(share: Fraction, m):
    return -(-share.numerator * m // share.denominator)


def content_id(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _split(key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers by key % parts."""
    k = (key % U64(parts)).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k = k[order]
    cut = np.flatnonzero(np.diff(k)) + 1
    for rows in np.split(order, cut):
        if len(rows):
            yield int((key[rows[0]]) % U64(parts)), rows


def _blobs(table: pa.Table, name: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), U64).reshape(-1, width)


_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def _narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Bytes a value, and the values in as many."""
    w = next(w for w in _WIDTHS if w == 4 or x.max(initial=0) < 1 << (8 * w))
    return w, x.astype(_WIDTHS[w])


def _five(g: np.ndarray) -> list[bytes]:
    """The low 40 bits of each gram."""
    return [g.astype(np.uint32).tobytes(), (g >> U64(32)).astype(np.uint8).tobytes()]


def _from_five(blob: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32, n, at).astype(U64) | (np.frombuffer(blob, np.uint8, n, at + 4 * n).astype(U64) << U64(32))


def _pack(g: np.ndarray, owner: np.ndarray, docs: int, levels: np.ndarray | None = None) -> bytes:
    """Which of the pack's documents has each gram, the low 40 bits of each gram (by document), and their levels.

    Documents are told by how many grams each has here, or by their numbers where that is shorter (few grams, as there are many parts).
    """
    width, many = _narrow(np.bincount(owner, minlength=docs))
    told = [bytes([width]), many.tobytes()]
    if 4 + 2 * len(g) < width * docs:
        told = [bytes([0]), np.uint32(len(g)).tobytes(), owner.astype(np.uint16).tobytes()]
    return b"".join([*told, *_five(g), b"" if levels is None else levels.tobytes()])


def _unpack(blob: bytes, docs: int, levels: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Grams, their documents' numbers, and their levels."""
    width = blob[0]
    if width:
        many = np.frombuffer(blob, _WIDTHS[width], docs, 1)
        n, at = int(many.sum(dtype=np.int64)), 1 + width * docs
        owner = np.repeat(np.arange(docs, dtype=np.uint16), many)
    else:
        n = int(np.frombuffer(blob, np.uint32, 1, 1)[0])
        owner, at = np.frombuffer(blob, np.uint16, n, 5), 5 + 2 * n
    return _from_five(blob, n, at), owner, np.frombuffer(blob, np.uint8, n, at + 5 * n) if levels else None


def pack_set(g: np.ndarray) -> bytes:
    """Grams (40 bits and their part above) in six, seven or nine bytes each."""
    width, part = _narrow(g >> U64(40))
    return b"".join([bytes([width]), *_five(g), part.tobytes()])


def unpack_set(blob: bytes) -> np.ndarray:
    width = blob[0]
    n = (len(blob) - 1) // (5 + width)
    return _from_five(blob, n, 1) | (np.frombuffer(blob, _WIDTHS[width], n, 1 + 5 * n).astype(U64) << U64(40))


def level_of(documents: np.ndarray) -> np.ndarray:
    """A byte that grows with the number of documents: the number itself up to 200."""
    far = 200 + np.ceil(4 * np.log2(np.maximum(documents, 200) / 200))
    return np.minimum(np.where(documents <= 200, documents, far), 255).astype(np.uint8)


def pack_common(g: np.ndarray, owner: np.ndarray, parts: int) -> tuple[np.ndarray, bytes, list[tuple[int, bytes]]]:
    """Which postings are of grams of less than COMMON documents, the others in one blob, and by part those grams and their numbers."""
    order = np.argsort(g, kind="stable")
    of = g[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(g) else np.zeros(0, int)
    many = np.diff(np.append(first, len(g)))
    rare = np.ones(len(g), bool)
    rare[order] = np.repeat(many < COMMON, many)
    own = np.flatnonzero(many >= COMMON)
    part = ((of[first[own]] >> U64(40)) % U64(parts)).astype(np.int64)
    own = own[np.argsort(part, kind="stable")]
    grams, counts, part = of[first[own]], many[own].astype(np.uint32), np.sort(part)
    owners = [owner[order[first[k] : first[k] + many[k]]] for k in own]
    blob = b"".join([np.uint32(len(own)).tobytes(), grams.tobytes(), counts.tobytes(), *(x.astype(np.uint16).tobytes() for x in owners)])
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(own) else np.zeros(0, int)
    return rare, blob, [(int(part[a]), b"".join([np.uint32(b - a).tobytes(), *_five(grams[a:b]), counts[a:b].tobytes()])) for a, b in zip(cut, np.append(cut[1:], len(own)))]


def unpack_common(blob: bytes, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common grams (with their part), by part; how many documents each has, and those documents."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    g, counts = np.frombuffer(blob, U64, n, 4), np.frombuffer(blob, np.uint32, n, 4 + 8 * n)
    return (g & U64((1 << 40) - 1)) | (((g >> U64(40)) % U64(parts)) << U64(40)), counts, np.frombuffer(blob, np.uint16, -1, 4 + 12 * n)


def grams_by_part(docs: DataFrame, n: int, parts: int, size_of_pack: int = PACK) -> DataFrame:
    """(part, origin, docs, posts, many, heads, common): the grams of a pack of documents, by part; heads and common go along with one part of a pack."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        heads: list[tuple[bytes, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            g = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
            head = b"".join(h[0] for h in heads) + np.array([h[1] for h in heads], np.int32).tobytes()
            rare, common, many = pack_common(g, owner, parts)
            g, owner = g[rare], owner[rare]
            part = ((g >> U64(40)) % U64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            g, owner, part = g[order], owner[order], part[order]
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(g) else np.zeros(0, int)
            own = origin % parts
            posts = {int(part[a]): _pack(g[a:b], owner[a:b], len(held)) for a, b in zip(cut, np.append(cut[1:], len(g)))}
            counted = dict(many)
            none = _pack(g[:0], owner[:0], len(held))
            rows = sorted({own, *posts, *counted})
            columns = [
                pa.array(rows, pa.int32()), pa.array([origin] * len(rows), pa.int64()), pa.array([len(heads)] * len(rows), pa.int32()), pa.array([posts.get(r, none) for r in rows], pa.binary()),
                pa.array([counted.get(r) for r in rows], pa.binary()), *(pa.array([x if r == own else None for r in rows], pa.binary()) for x in (head, common)),
            ]
            held.clear()
            heads.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "origin", "docs", "posts", "many", "heads", "common"])

        for batch in batches:
            for s in tk.slices(batch, "text"):
                words = tk.tokens(s.column("text"))
                for r in range(s.num_rows):
                    w = words.row(r)
                    if not len(w):
                        continue
                    g = np.unique(tk.ngrams(w, n))
                    held.append(g)
                    heads.append((content_id(w), len(g)))
                    size += len(g)
                    if size > size_of_pack or len(held) == 1 << 16:
                        yield flush()
                        origin += 1
                        size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(pack, "part int, origin long, docs int, posts binary, many binary, heads binary, common binary")


def count_part(t: pa.Table) -> pa.Table:
    """(origin, part, posts, levels, heads, common) of a part: back to each pack its grams that several documents share, with their levels, and the levels of its common ones."""
    part = t.column("part")[0].as_py()
    sizes = t.column("docs").to_pylist()
    grams, owners, common, numbers = [], [], [], []
    for posts, docs, many in zip(t.column("posts").to_pylist(), sizes, t.column("many").to_pylist()):
        g, owner, _ = _unpack(posts, docs)
        grams.append(g)
        owners.append(owner)
        n = int(np.frombuffer(many, np.uint32, 1)[0]) if many else 0
        common.append(_from_five(many, n, 4) if n else np.zeros(0, U64))
        numbers.append(np.frombuffer(many, np.uint32, n, 4 + 5 * n) if n else np.zeros(0, np.uint32))
    edge, far = (np.concatenate([[0], np.cumsum([len(x) for x in xs])]) for xs in (grams, common))
    rare, owner = np.concatenate(grams), np.concatenate(owners)
    grams, owners = None, None
    g = np.concatenate([rare, *common])
    weight = np.concatenate([np.ones(len(rare), np.uint32), *numbers])
    order = np.argsort(g, kind="stable")
    of = g[order]
    new = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(g) else np.zeros(0, int)
    levels = np.zeros(len(g), np.uint8)
    if len(g):
        levels[order] = np.repeat(level_of(np.add.reduceat(weight[order].astype(np.int64), new)), np.diff(np.append(new, len(g))))
    of, order, weight = None, None, None
    heads, origins, commons = (t.column(c).to_pylist() for c in ("heads", "origin", "common"))
    out = []
    for k, (a, b) in enumerate(zip(edge, edge[1:])):
        some = a + np.flatnonzero(levels[a:b] > 1)
        told = levels[len(rare) + far[k] : len(rare) + far[k + 1]].tobytes()
        if len(some) or told or heads[k] is not None:
            out.append((origins[k], part, _pack(rare[some], owner[some], sizes[k], levels[some]), told, heads[k], commons[k]))
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(zip(("origin", "part", "posts", "levels", "heads", "common"), kinds))})


def shared_grams(docs: DataFrame, n: int, share: Fraction, parts: int, size_of_pack: int = PACK) -> DataFrame:
    """(content, digest, size, indexed, grams) of documents of which a prefix gram is shared; grams are the shared ones, rare first, and the first ``indexed`` of them are in the prefix."""

    def gather(t: pa.Table) -> pa.Table:
        grams, owners, counts = [], [], []
        head, common = (next(x for x in t.column(c).to_pylist() if x is not None) for c in ("heads", "common"))
        docs = len(head) // 20
        for part, posts in zip(t.column("part").to_pylist(), t.column("posts").to_pylist()):
            g, owner, many = _unpack(posts, docs, True)
            grams.append(g | U64(part << 40))
            owners.append(owner)
            counts.append(many)
        told = dict(zip(t.column("part").to_pylist(), t.column("levels").to_pylist()))
        g, many, owner = unpack_common(common, parts)
        grams.append(np.repeat(g, many))
        owners.append(owner)
        counts.append(np.repeat(np.frombuffer(b"".join(told[p] for p in sorted(told)), np.uint8), many))
        g, owner, many = (np.concatenate(x) for x in (grams, owners, counts))
        order = np.lexsort((g, many, owner))
        g, owner = g[order], owner[order]
        size = np.frombuffer(head, np.int32, docs, 16 * docs)
        edge = np.searchsorted(owner, np.arange(docs + 1))
        # grams of one document come before the shared ones
        shared = np.diff(edge)
        indexed = np.minimum(size - ceil_of(share, size.astype(np.int64)) + 1 - (size - shared), shared)
        out = np.flatnonzero(indexed > 0)
        digests = [head[16 * k : 16 * k + 16] for k in out]
        return pa.table({"content": pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()), "digest": pa.array(digests, pa.binary()), "size": pa.array(size[out]), "indexed": pa.array(indexed[out].astype(np.int32)), "grams": pa.array([pack_set(g[edge[k] : edge[k + 1]]) for k in out], pa.binary())})

    answers = grams_by_part(docs, n, parts, size_of_pack).groupBy("part").applyInArrow(count_part, "origin long, part int, posts binary, levels binary, heads binary, common binary")
    return answers.groupBy("origin").applyInArrow(gather, "content long, digest binary, size int, indexed int, grams binary")


def postings(sets: DataFrame, parts: int) -> DataFrame:
    """(part, posts): blobs of (gram, content, size and position, the shared gram before or 0) of the shared grams in prefixes."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.zeros((0, 4), U64)]
            for c, m, p, blob in zip(*(b.column(x).to_pylist() for x in ("content", "size", "indexed", "grams"))):
                g = unpack_set(blob)
                x = np.zeros((p, 4), U64)
                x[:, 0], x[1:, 3] = g[:p], g[: p - 1]
                x[:, 1] = np.int64(c).view(U64)
                x[:, 2] = (m << 32) + m - len(g) + np.arange(p)
                held.append(x)
            x = np.concatenate(held)
            rows = [(p, x[r].tobytes()) for p, r in _split(tk.mix(x[:, 0]), parts)] if len(x) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "posts"])

    return sets.select("content", "size", "indexed", "grams").mapInArrow(index, "part int, posts binary")


def join_postings(x: np.ndarray, share: Fraction) -> Iterator[np.ndarray]:
    """Candidate pairs (lower, higher content) of postings, by the length, prefix and positional filters; distinct within each array.

    Two contents with the same gram before this one have met there, so a pair comes once for each run of grams that it shares.
    """
    num, den = share.numerator, share.denominator
    x = x[np.argsort(x[:, 0], kind="stable")]
    same = x[1:, 0] == x[:-1, 0]
    x = x[np.append(same, False) | np.append(False, same)]
    x = x[np.lexsort((x[:, 1], x[:, 2] >> U64(32), x[:, 0]))]
    if len(x):
        new = np.append(True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1]))
        x = x[new]  # copies
    gram, content, before = x[:, 0], x[:, 1], x[:, 3]
    size, pos = (x[:, 2] >> U64(32)).astype(np.int64), (x[:, 2] & U64(0xFFFFFFFF)).astype(np.int64)
    # the shorter of a pair meets the longer within its first m - ceil(2t/(1+t) m) + 1 grams
    near = size - ceil_of(Fraction(2 * num, num + den), size) + 1
    at = np.flatnonzero(pos < near)
    out, gathered = [], 0
    d = 1
    while len(at):
        at = at[at + d < len(x)]
        j = at + d
        alive = (gram[at] == gram[j]) & (num * size[j] <= den * size[at])
        at, j = at[alive], j[alive]
        need = -(-num * (size[at] + size[j]) // (num + den))
        ok = np.minimum(size[at] - pos[at], size[j] - pos[j]) >= need  # a pair has to be found at its first common gram only
        ok &= (before[at] != before[j]) | (before[at] == 0)
        a, b = content[at[ok]], content[j[ok]]
        pair = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
        out.append(pair)
        gathered += len(pair)
        if gathered > GATHERED:
            yield distinct(np.concatenate(out))
            out, gathered = [], 0
        d += 1
    if gathered:
        yield distinct(np.concatenate(out))


def distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))] if len(pairs) else pairs


def candidates(posts: DataFrame, share: Fraction, parts: int) -> DataFrame:
    """(label, part, n, pairs): blobs of n distinct candidate pairs (lower, higher content) whose higher contents have the same least partner, the label."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in join_postings(np.concatenate([_blobs(b, "posts", 4) for b in batches]), share):
            rows = [(p, pairs[r].tobytes()) for p, r in _split(tk.mix(pairs[:, 1]), parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "pairs"])

    def once(t: pa.Table) -> pa.Table:
        pairs = distinct(_blobs(t, "pairs", 2))
        pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
        new = np.append(True, pairs[1:, 1] != pairs[:-1, 1])
        label = pairs[new, 0][np.cumsum(new) - 1]  # pairs are sorted by the lower content within the higher
        order = np.argsort(label, kind="stable")
        pairs, label = pairs[order], label[order]
        cut = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        blobs = [x.tobytes() for x in np.split(pairs, cut[1:])]
        return pa.table({"label": pa.array(label[cut].view(np.int64)), "part": pa.array([t.column("part")[0].as_py()] * len(cut), pa.int32()), "n": pa.array([len(x) // 16 for x in blobs], pa.int64()), "pairs": pa.array(blobs, pa.binary())})

    return posts.groupBy("part").applyInArrow(meet, "part int, pairs binary").groupBy("part").applyInArrow(once, "label long, part int, n long, pairs binary")


def names(docs: DataFrame) -> DataFrame:
    """(content, digest, doc_id) of each document with a gram."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tk.slices(batch, "text"):
                words = tk.tokens(s.column("text"))
                some = np.flatnonzero(np.diff(words.rows))
                digests = [content_id(words.row(r)) for r in some]
                content = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(content), pa.array(digests, pa.binary()), s.column("doc_id").take(pa.array(some))], ["content", "digest", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "content long, digest binary, doc_id long")


def _bits(c: np.ndarray, log: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The slice of each content and three places within it."""
    h, mask = tk.mix(c), U64((1 << log) - 1)
    return (h >> U64(58)).astype(np.int64), [(x & mask).astype(np.int64) for x in (h, h >> U64(29), tk.mix(h))]


def in_candidates(sets: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """The sets of the n contents of ``own`` and few others, which the join behind drops.  Each slice of the filter is made by one task of its own contents, so nothing has to be merged."""
    if 16 * n > FILTER_BITS:
        return sets
    log = max(10, math.ceil(math.log2(16 * max(1, n) / SLICES)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("content").to_numpy().view(U64)
            rows = [(k, c[r].tobytes()) for k, r in _split(_bits(c, log)[0].astype(U64), SLICES)] if len(c) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "contents"])

    def build(t: pa.Table) -> pa.Table:
        held = np.zeros(1 << log, bool)
        for at in _bits(_blobs(t, "contents", 1)[:, 0], log)[1]:
            held[at] = True
        return pa.table({"slice": t.column("slice").slice(0, 1), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    made = dict(own.mapInArrow(split, "slice int, contents binary").groupBy("slice").applyInArrow(build, "slice int, bits binary").collect())
    shared = sets.sparkSession.sparkContext.broadcast(b"".join(made.get(k, bytes(1 << (log - 3))) for k in range(SLICES)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            piece, places = _bits(b.column("content").to_numpy().view(U64), log)
            hit = np.ones(len(piece), bool)
            for at in places:
                hit &= (bits[(piece << (log - 3)) + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            yield b.filter(pa.array(hit))

    return sets.mapInArrow(keep, sets.schema)


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """At most so many grams have the sorted sets in common, by the sizes of the pieces that x's medians cut both into."""
    at = np.arange(1, PIECES) * len(x) // PIECES
    there = np.searchsorted(y, x[at]) if len(x) else at
    own, other = np.diff(at, prepend=0, append=len(x)), np.diff(there, prepend=0, append=len(y))
    return int(np.minimum(own, other).sum())


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many grams the sets x[k] and y[k] have in common: one bit for each gram that several sets have."""
    grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(g) for g in sets])
    _, column, many = np.unique(grams, return_inverse=True, return_counts=True)
    some = many[column] > 1
    column, owner = (np.cumsum(many > 1) - 1)[column[some]], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    wide = int((many > 1).sum())
    both, step = np.zeros(len(x), np.int64), max(64, BITS // len(sets) // 64 * 64)
    for at in range(0, wide, step):
        a, b = np.searchsorted(column, [at, at + step])
        cells = np.zeros((len(sets), -(-min(step, wide - at) // 64) * 64), bool)
        cells[owner[a:b], column[a:b] - at] = True
        bits = np.packbits(cells, axis=1).view(U64)
        n = max(1, 500_000 // bits.shape[1])
        for k in range(0, len(x), n):
            both[k : k + n] += np.bitwise_count(bits[x[k : k + n]] & bits[y[k : k + n]]).sum(axis=1, dtype=np.int64)
    return both


def overlap(p: np.ndarray, q: np.ndarray, least: int) -> int:
    """How many grams two sorted sets have in common; 0 if the suffix filter tells that there are less than ``least``."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p) or suffix_bound(p, q) < least:
        return 0
    i = np.searchsorted(q, p)
    i[i == len(q)] = 0
    return int((q[i] == p).sum())


def roots_of(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least id that each row is connected to by the pairs (x[k], y[k])."""
    root = ids.copy()
    while True:
        before, least = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        if (root == before).all():
            return root


def verify(pairs: DataFrame, sets: DataFrame, least: DataFrame, share: Fraction, counted: bool = False) -> DataFrame:
    """(doc_a, doc_b, jaccard) of the candidates at or above the threshold; least has (content, digest, least).

    ``counted``: instead, for each content and label, (content, digest, least, root, links): the least id that its pairs of the label
    connect it to, and how many documents its partners there have, which least then tells as ``many``.  No pair leaves its task.

    A cluster's pairs mostly share a label and go to one part, so its contents' grams travel once; large clusters are spread over several parts.
    """
    num, den = share.numerator, share.denominator
    spread = pairs.groupBy("label").agg(F.ceil(F.sum("n") / TOGETHER).alias("ways"))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    parts = max(12, math.ceil(total / PAIRS) * 4)
    put = F.pmod(F.xxhash64("label", F.pmod("part", F.col("ways"))), F.lit(parts)).cast("int")
    placed = pairs.join(spread, "label").select(put.alias("part"), "label", "pairs")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("pairs").to_pylist()):
                c = np.unique(np.frombuffer(blob, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), pa.array(c)], ["place", "content"])

    wanted = stored(placed.select("part", "pairs").mapInArrow(ends, "place int, content long").distinct(), "wanted")
    own = stored(wanted.select("content").distinct(), "contents")
    once = in_candidates(sets, own, own.count()).groupBy("content", "digest").agg(F.first("size").alias("size"), F.first("grams").alias("grams"))
    # grams are shuffled twice, by content and by place; what is joined to them is narrow
    there = once.join(wanted.join(least, "content"), ["content", "digest"]).select("place", "content", "digest", "size", "grams", "least", *["many"] * counted)

    def matches(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of right, and how many grams they have in common, by label."""
        content, ids, size = (right.column(c).to_numpy().astype(np.int64) for c in ("content", "least", "size"))
        grams = [np.sort(unpack_set(g)) for g in right.column("grams").to_pylist()]
        order = np.argsort(content, kind="stable")
        of = content[order]
        labels, blobs = left.column("label").to_numpy(), left.column("pairs").to_pylist()
        by_label = np.argsort(labels, kind="stable")
        for rows in np.split(by_label, np.flatnonzero(np.diff(labels[by_label])) + 1):
            ab = np.frombuffer(b"".join(blobs[r] for r in rows), np.int64).reshape(-1, 2)
            # contents with equal ids are told apart by their digests: all of them are compared
            x, y = ab[:, 0], ab[:, 1]
            from_x, from_y = (np.searchsorted(of, c) for c in (x, y))
            many_x, many_y = (np.searchsorted(of, c, "right") - f for c, f in ((x, from_x), (y, from_y)))
            ways = many_x * many_y
            pair = np.repeat(np.arange(len(ab)), ways)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(ways) - ways, ways)
            x, y = order[from_x[pair] + nth // many_y[pair]], order[from_y[pair] + nth % many_y[pair]]
            need = -(-num * (size[x] + size[y]) // (num + den))
            if len(x) < DENSE:
                both = np.array([overlap(grams[i], grams[j], n) for i, j, n in zip(x, y, need)], np.int64)
            else:
                used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                both = overlaps([grams[k] for k in used], at[: len(x)], at[len(x) :])
            hit = both >= need
            if not counted:
                hit &= ids[x] != ids[y]
            yield x[hit], y[hit], both[hit]

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, size = (right.column(c).to_numpy().astype(np.int64) for c in ("least", "size"))
        out = [(ids[x], ids[y], both / (size[x] + size[y] - both)) for x, y, both in matches(left, right)] if left.num_rows and right.num_rows else []
        a, b, j = (np.concatenate([np.zeros(0, kind), *(r[k] for r in out)]) for k, kind in enumerate((np.int64, np.int64, float)))
        return pa.table({"doc_a": np.minimum(a, b), "doc_b": np.maximum(a, b), "jaccard": j})

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, many = (right.column(c).to_numpy().astype(np.int64) for c in ("least", "many"))
            for x, y, _ in matches(left, right):
                rows, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                x, y = at[: len(x)], at[len(x) :]
                links = np.bincount(x, many[rows[y]], len(rows)) + np.bincount(y, many[rows[x]], len(rows))
                out.append((rows, roots_of(ids[rows], x, y), links.astype(np.int64)))
        rows, root, links = (np.concatenate([np.zeros(0, np.int64), *(r[k] for r in out)]) for k in range(3))
        told = right.select(["content", "digest", "least"]).take(pa.array(rows))
        return told.append_column("root", pa.array(root)).append_column("links", pa.array(links))

    if counted:
        return placed.groupBy("part").cogroup(there.groupBy("place")).applyInArrow(count, "content long, digest binary, least long, root long, links long")
    return placed.groupBy("part").cogroup(there.groupBy("place")).applyInArrow(check, "doc_a long, doc_b long, jaccard double")


def scale(spark) -> float:
    """How much more heap a core has than MEMORY; 1 where it isn't told."""
    memory, cores = (spark.conf.get(f"spark.executor.{x}", None) for x in ("memory", "cores"))
    if not memory or not cores:
        return 1.0
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    digits = memory.lower().rstrip("b")
    size = float(digits[:-1]) * unit[digits[-1]] if digits[-1] in unit else float(digits) * unit["m"]
    return max(1.0, size / int(cores) / MEMORY)


def _joined(docs: DataFrame, n: int, threshold: float, part_bytes: int | None) -> tuple[DataFrame, DataFrame, DataFrame, Fraction]:
    """Candidate pairs, gram sets, (content, digest, doc_id) of the documents, and the threshold."""
    spark = docs.sparkSession
    share = Fraction(str(threshold))
    if not 0 < share <= 1:
        raise ValueError("threshold must be in (0, 1]")
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    by = scale(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (part_bytes or PART_BYTES * by)))
    sets = stored(shared_grams(docs, n, share, parts, int(PACK * by)), "shared-grams")
    meeting = max(12, math.ceil((sets.agg(F.sum("indexed")).first()[0] or 0) * 32 / (POSTINGS * by)))
    pairs = stored(candidates(postings(sets, meeting), share, meeting), "candidates")
    every = stored(names(docs), "names").repartition("content").distinct()
    return pairs, sets, every, share


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, part_bytes: int | None = None) -> DataFrame:
    """Pairs (doc_a < doc_b, jaccard) as told above, stored; jaccard has six decimals.

    A lost task is run again, so docs has to give the same rows in the same order again, as files and stored tables do.
    """
    with scratch(docs.sparkSession):
        pairs, sets, every, share = _joined(docs, n, threshold, part_bytes)
        least = every.groupBy("content", "digest").agg(F.min("doc_id").alias("least"))
        copies = every.join(least, ["content", "digest"]).select(F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")).where("doc_a <> doc_b")
        near = verify(pairs, sets, least, share).withColumn("jaccard", F.round("jaccard", 6))
        return stored(near.unionByName(copies), "pairs", keep=True)


def all_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, part_bytes: int | None = None) -> DataFrame:
    """(doc_a < doc_b, jaccard) of all similar documents, k (k - 1) / 2 rows for k copies; of a doc_id with several texts the most similar counts.  Stored."""
    with scratch(docs.sparkSession):
        pairs, sets, every, share = _joined(docs, n, threshold, part_bytes)
        own = every.select("content", "doc_id")
        side = lambda x: own.select(F.col("content").alias(f"c{x}"), F.col("doc_id").alias(x))
        same = every.select("content", "digest").distinct().withColumn("least", F.col("content"))
        near = verify(pairs, sets, same, share).select(F.col("doc_a").alias("ca"), F.col("doc_b").alias("cb"), F.round("jaccard", 6).alias("jaccard"))
        near = near.join(side("a"), "ca").join(side("b"), "cb").select("a", "b", "jaccard")
        copies = side("a").join(side("b"), F.col("ca") == F.col("cb")).select("a", "b", F.lit(1.0).alias("jaccard"))
        both = near.unionByName(copies).where("a <> b").groupBy(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))
        return stored(both, "pairs", keep=True)


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, root): the least doc_id of each document's connected component, for documents in any pair, stored.

    Alternates large-star and small-star steps, which end after O(log^2 n) rounds; each round is written to the shared folder.
    """
    with scratch(pairs.sparkSession):
        return _components(pairs)


def _components(pairs: DataFrame) -> DataFrame:
    edges = stored(pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).where("u <> v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = both.join(low, "u")
        if large:
            return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        return r.n, r.h

    edges = stored(star(edges, False).where("u <> v").distinct(), "edges")
    before = mark(edges)
    while True:
        with scratch(pairs.sparkSession):
            wide = stored(star(edges, True).where("u <> v").distinct(), "edges")
            edges = stored(star(wide, False).where("u <> v").distinct(), "edges", keep=True)
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
    return stored(roots.unionByName(roots.select(F.col("root").alias("doc_id"), "root").distinct()), "roots", keep=True)


def _linked(docs: DataFrame, n: int, threshold: float, part_bytes: int | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, links) of documents with grams, by text, and edges (doc_a, doc_b) that connect the documents of each class."""
    pairs, sets, every, share = _joined(docs, n, threshold, part_bytes)
    own = every.groupBy("content", "digest").agg(F.min("doc_id").alias("least"), F.count("doc_id").alias("many"))
    met = stored(verify(pairs, sets, own, share, counted=True), "met")
    near = met.groupBy("content", "digest").agg(F.sum("links").alias("near"))
    texts = every.join(own.join(near, ["content", "digest"], "left"), ["content", "digest"])
    texts = stored(texts.select("doc_id", "least", (F.col("many") - 1 + F.coalesce("near", F.lit(0))).alias("links")), "texts")
    edges = met.select(F.col("root").alias("doc_a"), F.col("least").alias("doc_b")).unionByName(texts.select(F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b")))
    return texts.select("doc_id", "links"), edges.where("doc_a <> doc_b")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, part_bytes: int | None = None) -> DataFrame:
    """(doc_id, class_id, links) of each document, stored: the least doc_id of its class and the number of documents that are similar to it, its copies among them."""
    with scratch(docs.sparkSession):
        links, edges = _linked(docs, n, threshold, part_bytes)
        roots = components(edges)
        ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        out = ids.join(links.groupBy("doc_id").agg(F.sum("links").alias("links")), "doc_id", "left").join(roots, "doc_id", "left")
        return stored(out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "classes", keep=True)


def one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Documents without those that have a smaller doc_id in their group of similar documents; rows with a null doc_id stay."""
    with scratch(docs.sparkSession):
        groups = components(_linked(docs, n, threshold, None)[1])
        gone = stored(groups.where("doc_id <> root").select(F.col("doc_id").alias("_gone")).distinct(), "gone", keep=True)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB, by brute force over all contents that share a gram."""
    grams = f"case when len(w) < {n} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) end"
    return f"""
with t as (select doc_id, {tk.token_sql()} as w from documents where doc_id is not null),
c as (select array_to_string(w, ' ') as k, min(doc_id) as r, any_value(w) as w from t where len(w) > 0 group by 1),
g as (select r, unnest({grams}) as g from c),
s as (select r, count(*) as m from g group by r),
o as (select x.r as a, y.r as b, count(*) as ov from g x join g y on x.g = y.g and x.r < y.r group by 1, 2),
p as (select a, b, ov / (p.m + q.m - ov) as j, ov, p.m + q.m as total from o join s p on p.r = a join s q on q.r = b)
select a as doc_a, b as doc_b, round(cast(j as double), 6) as jaccard from p where ov * {1 + threshold} >= total * {threshold} - 1e-9
union all
select c.r, t.doc_id, 1.0 from t join c on array_to_string(t.w, ' ') = c.k where t.doc_id <> c.r
"""


def oracle_all(n: int = N, threshold: float = THRESHOLD) -> str:
    """all_pairs in DuckDB: every pair of documents, compared by brute force."""
    grams = f"case when len(w) < {n} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) end"
    return f"""
with t as (select distinct doc_id, {tk.token_sql()} as w from documents where doc_id is not null and text is not null),
g as (select doc_id, {grams} as g, w from t where len(w) > 0),
p as (select a.doc_id as doc_a, b.doc_id as doc_b, case when a.w = b.w then 1.0 else len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)) end as j from g a join g b on a.doc_id < b.doc_id)
select doc_a, doc_b, round(cast(max(j) as double), 6) as jaccard from p where j >= {threshold} - 1e-9 group by 1, 2
"""


def oracle_classes(n: int = N, threshold: float = THRESHOLD) -> str:
    """classes in DuckDB: contents compared by brute force, classes by following all links."""
    grams = f"case when len(w) < {n} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) end"
    return f"""
with recursive t as (select distinct doc_id, {tk.token_sql()} as w from documents where doc_id is not null),
c as (select w, min(doc_id) as r, count(*) as many, row_number() over () as c from t where len(w) > 0 group by w),
g as (select c, unnest({grams}) as g from c),
s as (select c, count(*) as m from g group by 1),
o as (select x.c as a, y.c as b, count(*) as ov from g x join g y on x.g = y.g and x.c <> y.c group by 1, 2),
p as (select a, b from o join s p on p.c = a join s q on q.c = b where ov * {1 + threshold} >= (p.m + q.m) * {threshold} - 1e-9),
l as (select a, sum(c.many) as near from p join c on c.c = b group by 1),
d as (select t.doc_id, c.r, c.many - 1 + coalesce(l.near, 0) as links from t join c on t.w = c.w left join l on l.a = c.c),
e as (select x.r as u, y.r as v from p join c x on x.c = a join c y on y.c = b union select doc_id, r from d union select r, doc_id from d),
k as (select doc_id as u, doc_id as root from t union select e.v, k.root from k join e on e.u = k.u)
select i.doc_id, min(k.root) as class_id, any_value(coalesce(links, 0)) as links
from (select t.doc_id, cast(sum(links) as bigint) as links from (select distinct doc_id from t) t left join d on d.doc_id = t.doc_id group by 1) i join k on k.u = i.doc_id group by 1
"""
