"""Texts of an Arrow batch as flat numpy arrays: words, hashes, segments.

Small helpers that run inside tasks; Spark does the partitioning and the shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task turns into numpy arrays at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Deal 64-bit hashes into ``shards`` files or groups."""
    return ((mix(key + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as large binary, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows of at most ``limit`` bytes, or of one row."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all else as it is."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+``, and how many words each text has.

    ``between`` tells for each of the 256 bytes whether it parts words.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order, not empty and don't overlap.

    Spans are hashed some megabytes at a time, so that memory stays bounded.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(starts) > 1 and ends[-1] - starts[0] > 2 * SLICE_BYTES:
        cuts = np.unique(np.searchsorted(starts, np.arange(starts[0], ends[-1], SLICE_BYTES)))
        cuts = [0, *cuts[(cuts > 0) & (cuts < len(starts))].tolist(), len(starts)]
        return np.concatenate([_hashed(data, starts[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return _hashed(data, starts, ends)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    total = int(lengths.sum())
    begin = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=begin[1:])
    place = np.arange(total, dtype=np.int64) - np.repeat(begin, lengths)
    picked = data[place + np.repeat(starts, lengths)]
    powers = np.full(int(lengths.max()), _STEP)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.add.reduceat(_RANDOM[picked] * powers[place], begin)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each place on, which may overlap; by sums up to each place."""
    powers, back = np.full(len(data) + 1, _STEP), np.full(len(data) + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    powers[0] = back[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(back, out=back)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_RANDOM[data] * powers[:-1], dtype=np.uint64)]
    return mix((sums[starts + length] - sums[starts]) * back[starts])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i]+lengths[i]-1`` of all ``i``, one after the other."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - begin, lengths)
