"""Files in the shared folder of the cluster that every worker can open, and how many shards data takes.

The folder is the one that ``spark.checkpoint.dir`` names; see :mod:`graphloom.session`.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import fresh, shared_dir, written

__all__ = ["BitFilter", "HashFiles", "Maps", "fresh", "map_file", "mounted", "once", "only", "put_file", "shards_for", "shared_dir", "store_filter", "store_hashes", "unused", "written"]

#: Bytes of the table that a shard stands for; what a task holds of one shard is a small multiple.
SHARD_BYTES = 64 << 20


def shards_for(df: DataFrame) -> int:
    """How many shards the data of ``df`` is dealt into: by its bytes, and at least one per shuffle partition.

    The bytes are the planner's estimate, which for files is their size; where it knows none,
    the strings and binaries are measured.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 52:
        long = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
        size = df.agg(*(F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)).alias(c) for c in long)).first() if long else (0,)
        size = int(sum(size))
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def mounted(uri: str) -> str:
    """How workers name files below a folder: by path where it is mounted, else by URI."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else uri


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, opened from a worker, and the path in it."""
    return fs.FileSystem.from_uri(path)


def put_file(path: str, *arrays) -> None:
    """Write arrays of one length one after the other, each at a multiple of 64 bytes, all or nothing.

    The first 64 bytes hold the length. A retried or speculative task writes the same bytes:
    on a mounted folder under another name first, and the rename replaces whole files only; an
    object store shows an object only once it is whole.
    """
    parts = []
    for a in (np.array([len(arrays[0])], np.int64), *arrays):
        raw = a.tobytes()
        parts += [raw, b"\0" * (-len(raw) % 64)]
    if "://" in path:
        store, at = _store(path)
        with store.open_output_stream(at) as f:
            for x in parts:
                f.write(x)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        for x in parts:
            f.write(x)
    os.replace(part, path)


#: Bytes of local copies that a node keeps of files in a store that cannot be mounted, and maps that a worker keeps open.
CACHE_BYTES, OPEN_MAPS = 16 << 30, 1024


def _make_room(folder: str, size: int) -> None:
    """Remove the copies that were used longest ago, until ``size`` more bytes fit; open maps of them stay valid."""
    known = []
    for entry in os.scandir(folder):
        with contextlib.suppress(FileNotFoundError):  # another worker may be at it too
            known.append((entry.stat().st_atime_ns, entry.stat().st_size, entry.path))
    held = sum(n for _, n, _ in known)
    for _, n, path in sorted(known):
        if held + size <= CACHE_BYTES:
            return
        with contextlib.suppress(FileNotFoundError):
            os.remove(path)
        held -= n


def _near(path: str) -> str | None:
    """A local copy of a file in a store that cannot be mounted; a bounded cache that a lost worker's successor fills again."""
    copy = os.path.join(tempfile.gettempdir(), "graphloom-cache", hashlib.sha256(path.encode()).hexdigest())
    with contextlib.suppress(FileNotFoundError):
        os.utime(copy)
        return copy
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return None
    os.makedirs(os.path.dirname(copy), exist_ok=True)
    _make_room(os.path.dirname(copy), info.size)
    part = f"{copy}.{uuid.uuid4().hex}"
    with store.open_input_stream(at) as f, open(part, "wb") as out:
        while chunk := f.read(1 << 22):
            out.write(chunk)
    os.replace(part, copy)
    return copy


def map_file(path: str, types: tuple) -> list[np.ndarray]:
    """The arrays of :func:`put_file`, mapped into memory; a missing file has empty arrays."""
    raw = None
    while raw is None:
        here = _near(path) if "://" in path else path if os.path.exists(path) else None
        if here is None:
            return [np.zeros(0, t) for t in types]
        with contextlib.suppress(FileNotFoundError):  # a copy may have been removed to make room just now
            raw = np.memmap(here, np.uint8, "r")
    n, at, out = int(raw[:8].view(np.int64)[0]), 64, []
    for t in types:
        end = at + n * np.dtype(t).itemsize
        out.append(raw[at:end].view(t))
        at = -(-end // 64) * 64
    return out


class Maps:
    """Mapped files of a worker, of which the ones used last stay open; a map takes one of the few that a process may have."""

    def __init__(self):
        self.open: dict[str, list[np.ndarray]] = {}

    def get(self, path: str, types: tuple) -> list[np.ndarray]:
        found = self.open.pop(path, None)
        if found is None:
            found = map_file(path, types)
            if len(self.open) >= OPEN_MAPS:
                del self.open[next(iter(self.open))]
        self.open[path] = found  # the last one now
        return found


def store_hashes(hashes: DataFrame, kind: str) -> HashFiles:
    """Distinct values of the one long column of ``hashes`` as sorted files in the shared folder.

    Tasks look values up by binary search in the mapped files, so a set of any size
    filters a scan without a shuffle of the scanned rows and without a broadcast.
    """
    folder, shards = mounted(fresh(hashes.sparkSession, kind)), shards_for(hashes)

    def put(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            shard, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s in np.unique(shard).tolist():
                held.setdefault(s, []).append(value[shard == s])
        for s, parts in held.items():
            put_file(f"{folder}/{s}", np.unique(np.concatenate(parts)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32())], ["shard"])

    column = hashes.columns[0]
    dealt = hashes.where(f"`{column}` is not null").distinct().select(F.pmod(F.xxhash64(column), F.lit(shards)).cast("int").alias("shard"), column)
    dealt.repartition(shards, "shard").mapInArrow(put, "shard int").agg(F.count("*")).collect()
    return HashFiles(folder, shards)


@dataclass(frozen=True)
class HashFiles:
    """Files of :func:`store_hashes`; a task finds the shard of a value by Spark's own hash, given as a column."""

    folder: str
    shards: int

    def shard(self, column: str | Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.shards)).cast("int")

    def has(self, shard: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(value), bool)
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            (stored,) = map_file(f"{self.folder}/{s}", (np.int64,))
            if len(stored):
                at = np.minimum(np.searchsorted(stored, value[own]), len(stored) - 1)
                out[own] = stored[at] == value[own]
        return out


#: Bits of a filter for each value, the most that a filter has, and those of one file.
FILTER_BITS, FILTER_MOST, FILTER_FILE = 16, 1 << 32, 1 << 26


@dataclass(frozen=True)
class BitFilter:
    """Files of :func:`store_filter`: a set of 64-bit hashes that has false members but misses none."""

    folder: str
    bits: int
    per: int  # bits of one file

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The file and two bits in it for each hash."""
        per = np.uint64(self.per - 1)
        two = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return ((h >> np.uint64(32)) % np.uint64(self.bits // self.per)).astype(np.int64), h & per, two & per

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        file, one, two = self.places(h)
        for f in np.unique(file).tolist():
            own = np.flatnonzero(file == f) if self.bits > self.per else slice(None)
            (held,) = map_file(f"{self.folder}/{f}", (np.uint8,))
            if len(held):
                out[own] = np.logical_and(*((held[(x[own] >> np.uint64(3)).astype(np.int64)] >> (x[own] & np.uint64(7)).astype(np.uint8)) & 1 for x in (one, two)))
        return out


def store_filter(hashes: DataFrame, kind: str) -> BitFilter:
    """The one long column of ``hashes`` as a bit table in the shared folder.

    Its size follows the number of hashes up to a bound, beyond which it lets more through; callers
    only save work by it and decide by exact counts.
    """
    n, column = hashes.count(), hashes.columns[0]
    bits = 1 << min(FILTER_MOST.bit_length() - 1, max(16, (FILTER_BITS * n).bit_length()))
    made = BitFilter(mounted(fresh(hashes.sparkSession, kind)), bits, min(bits, FILTER_FILE))
    files = bits // made.per

    def put(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            file, one, two = made.places(batch.column(1).to_numpy().view(np.uint64))
            for f in np.unique(file).tolist():
                table = held.setdefault(f, np.zeros(made.per // 8, np.uint8))
                at = np.concatenate([one[file == f], two[file == f]])
                np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7), dtype=np.uint64).astype(np.uint8))
        for f, table in held.items():
            put_file(f"{made.folder}/{f}", table)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64())], ["file"])

    file = F.pmod(F.shiftrightunsigned(column, 32), F.lit(files)).alias("file")
    hashes.select(file, column).repartition(files, "file").mapInArrow(put, "file long").agg(F.count("*")).collect()
    return made


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of letters."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def only(df: DataFrame, h: Column, hashes: DataFrame, kind: str, but: bool = False) -> DataFrame:
    """Rows of ``df`` whose hash ``h`` is in the one column of ``hashes``, or all but those; wide rows are neither shuffled nor sent to Python.

    Exact where ``h`` is the hash of one integer, which no other integer shares.
    """
    known = store_hashes(hashes, kind)

    @F.arrow_udf("boolean")
    def held(shard: pa.Array, value: pa.Array) -> pa.Array:
        return pa.array(known.has(shard.to_numpy(zero_copy_only=False), value.to_numpy(zero_copy_only=False)), pa.bool_())

    found = held(known.shard(h), h)
    return df.where(~found if but else found)


def once(df: DataFrame, column: str) -> DataFrame:
    """One row of each value of ``column``, which is not null; of ``df``, a table, only rows whose value occurs again are shuffled."""
    again = written(df.groupBy(column).count().where("count > 1").select(column), "again")
    if again.isEmpty():
        return df
    return written(df.join(again, column, "left_anti").unionByName(df.join(again, column, "left_semi").dropDuplicates([column])), "once")
