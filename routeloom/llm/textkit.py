"""Vectorised text helpers shared by the operators of this package.

A *token* is a maximal run of letters, digits and combining marks of the
lower-cased text; every other character separates.  In SQL the same tokens are
``regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g')`` split at blanks.
Tokens are represented by 64-bit hashes that are computed for a whole Arrow
slice at once, straight from its UTF-8 buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_ODD = r"[^\x00-\x7F\p{L}\p{N}\p{M}]"

_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those of the usual size are kept, longer ones aren't."""

    def power(base: int, size: int) -> np.ndarray:
        a = np.full(size, base, U64)
        a[0] = 1
        return np.multiply.accumulate(a)

    if n > SLICE_BYTES + 1:
        return power(_BASE, n), power(_INV, n)
    if not _tables:
        _tables.update(p=power(_BASE, SLICE_BYTES + 1), i=power(_INV, SLICE_BYTES + 1))
    return _tables["p"], _tables["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and its n + 1 row offsets into them."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


@dataclass
class Tokens:
    hashes: np.ndarray  # uint64, one for each token
    rows: np.ndarray  # row r has the tokens rows[r]:rows[r + 1]

    def row(self, r: int) -> np.ndarray:
        return self.hashes[self.rows[r] : self.rows[r + 1]]

    def each(self) -> list[np.ndarray]:
        return np.split(self.hashes, self.rows[1:-1]) if len(self.rows) > 1 else []


def lowered(col: pa.Array) -> pa.Array:
    """Lower case, null as empty, non-ASCII separators as blanks."""
    low = pc.utf8_lower(pc.fill_null(col, ""))
    odd = pc.match_substring_regex(low, _ODD)
    if pc.any(odd).as_py():
        low = pc.if_else(odd, pc.replace_substring_regex(low, _ODD + "+", " "), low)
    return low


def normalised(col: pa.Array) -> pa.Array:
    """Tokens of each row joined by one blank."""
    return pc.utf8_trim(pc.replace_substring_regex(lowered(col), r"[^\p{L}\p{N}\p{M}]+", " "), " ")


def _blocks(word: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of a buffer behind separators, at most ``limit`` bytes apart but for longer tokens."""
    at, n = 0, len(word)
    while at < n:
        to = min(n, at + limit)
        if to < n:
            gap = np.flatnonzero(~word[at:to])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                gap = np.flatnonzero(~word[to:])
                to = to + int(gap[0]) + 1 if len(gap) else n
        yield at, to
        at = to


def tokens(col: pa.Array, limit: int = SLICE_BYTES) -> Tokens:
    """Token hashes of a column; temporary arrays are those of ``limit`` bytes, however long a row is."""
    raw, off = buffers(lowered(col))
    word = _WORD[raw]
    hashes, starts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    edges = off[(off > 0) & (off < len(raw))]
    for a, b in _blocks(word, limit):
        own = word[a:b]
        edge = edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, b)] - a
        before, after = np.empty(b - a, bool), np.empty(b - a, bool)
        before[0], before[1:] = False, own[:-1]
        before[edge] = False
        after[-1], after[:-1] = False, own[1:]
        after[edge - 1] = False
        start = np.flatnonzero(own & ~before)
        end = np.flatnonzero(own & ~after) + 1
        p, i = _powers(b - a)
        total = np.zeros(b - a + 1, U64)
        np.cumsum((raw[a:b].astype(U64) + U64(1)) * p[: b - a], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * i[start]))
        starts.append(start + a)
    return Tokens(np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one row, in order; a row of 1 to n - 1 tokens is one gram of all of them."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    g = np.full(m, n, U64)
    for j in range(n):
        g = g * U64(_BASE) + words[j : j + m]
    return mix(g)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where the column's bytes reach the limit, so that temporary arrays stay small.  A longer row comes alone."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def token_sql(text: str = "text") -> str:
    """DuckDB: list of the tokens of a text, [] for none."""
    return f"list_filter(string_split(trim(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'), ' '), ' '), lambda x: x <> '')"
