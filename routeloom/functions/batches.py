"""Arrow batches in pieces of bounded bytes: however many rows a batch has, no more than a piece of them are Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20


def spans(*texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of pieces of which the texts have up to ``limit`` bytes together; a longer row comes alone."""
    size = np.zeros(len(texts[0]), np.int64)
    for x in texts:
        if not pa.types.is_null(x.type):
            size += pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to - at
        at = to


def pieces(*texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[list[list[str | None]]]:
    """Each piece as one list of strings a column."""
    for at, n in spans(*texts, limit=limit):
        yield [x.slice(at, n).to_pylist() for x in texts]
