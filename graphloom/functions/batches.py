"""Arrow batches taken piece by piece, so that a Python task holds the objects of few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text after which a piece ends.
PIECE = 1 << 18


def cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and length of pieces of about :data:`PIECE` bytes; a longer text is a piece of its own or ends one."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.flatnonzero(np.diff((np.cumsum(size) - size) // PIECE, prepend=-1))
    for begin, end in zip(begins, np.append(begins, len(size))[1:], strict=True):
        yield int(begin), int(end - begin)


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces by the bytes of a text column."""
    for batch in batches:
        for begin, length in cuts(batch.column(column)):
            yield batch.slice(begin, length)


def mapped(f: Callable, texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """``f`` of every text."""
    parts = [pa.array([f(t) for t in texts.slice(*cut).to_pylist()], kind) for cut in cuts(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
