"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A document is its token ids and one end id. Only documents longer than a sequence are cut,
into full pieces and a shorter last one. Which lengths share a sequence is planned from
the number of pieces of each length alone: at most ``capacity`` numbers, however many
documents there are. The plan fills a bin greedily with the longest lengths that fit, then
replaces the bin's smallest piece by two unpacked pieces that fit the gap it leaves more
tightly, and repeats each such pattern as often as the counts allow. Pieces then take the
plan's places by their rank among the pieces of their length, counted per hash bucket, so
no length, however common, meets in one task.

Defined results: a null or empty text is one piece holding the end id; an empty table
gives no rows; equal documents are packed like any others; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import codec, groups
from graphloom.llm.shared import written
from graphloom.session import reach_workers


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of each piece of every document; a narrow map."""
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                ids, offsets = bpe.encode(texts[a:b])
                # every document's ids, each followed by the end id
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                sizes = np.diff(offsets)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(capacity, sizes[row] - start)
                raw, at = memoryview(ids.tobytes()), (offsets[row] + start) * 4
                crc = [zlib.crc32(raw[x : x + y]) for x, y in zip(at.tolist(), (length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_id", id_col)


def _largest(left: np.ndarray, gap: int) -> int:
    """The largest length up to ``gap`` of which pieces are left, or 0."""
    at = np.flatnonzero(left[1 : gap + 1])
    return int(at[-1]) + 1 if len(at) else 0


def _best_two(left: np.ndarray, gap: int, above: int) -> tuple[int, int] | None:
    """Two lengths that are left, together the most up to ``gap`` and more than ``above``."""
    lengths = np.flatnonzero(left[: gap + 1])
    if not len(lengths):
        return None
    # the largest partner of each length within the gap
    at = np.searchsorted(lengths, gap - lengths, side="right") - 1
    at = np.where((at >= 0) & (lengths[at] == lengths) & (left[lengths] < 2), at - 1, at)
    total = np.where(at >= 0, lengths + lengths[at], 0)
    best = int(np.argmax(total))
    return (int(lengths[best]), int(lengths[at[best]])) if total[best] > above else None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """``(lengths of a sequence, how many such sequences)`` that use up ``counts[length]`` pieces of each length."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        items, gap = [top], capacity - top
        left[top] -= 1
        while gap and (x := _largest(left, gap)):
            items.append(x)
            left[x] -= 1
            gap -= x
        if gap and len(items) > 1 and (two := _best_two(left, gap + items[-1], items[-1])):
            left[items.pop()] += 1
            for x in two:
                items.append(x)
                left[x] -= 1
        # the same choices hold while every length of the pattern is left
        used = np.bincount(items, minlength=len(left))
        own = np.flatnonzero(used)
        more = int((left[own] // used[own]).min())
        left[own] -= more * used[own]
        out.append((items, more + 1))


def pack(rows: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """``rows`` of :func:`pieces` with ``sequence_id`` and ``offset``, gapless from 0 in each sequence."""
    reach_workers(rows.sparkSession)
    spark = rows.sparkSession
    rows = written(rows, "pieces")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    # at most capacity x buckets rows; only their sum per length, capacity numbers, reaches the driver
    sizes = written(rows.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "sizes")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    # places of each length in the order of the plan: ranks first..first+times-1 take slot ``offset`` of sequences base..
    taken, base, slots = np.zeros(capacity + 1, np.int64), 0, []
    for items, times in plan(counts, capacity):
        offset = 0
        for x in items:
            slots.append((x, taken[x], base, offset))
            taken[x] += times
            offset += x
        base += times
    slot = pd.DataFrame(slots, columns=["length", "first", "base", "offset"]).sort_values(["length", "first"]).astype(np.int64)
    begins = np.searchsorted(slot["length"].to_numpy(), np.arange(capacity + 2))
    first, bases, offsets = (slot[c].to_numpy() for c in ("first", "base", "offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                low, high = begins[x], begins[x + 1]
                at[own] = low + np.searchsorted(first[low:high], rank[own], side="right") - 1
            more = [pa.array(bases[at] + rank - first[at], pa.int64()), pa.array(offsets[at], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(id_col, "piece")
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(shift, ["length", "_bucket"])
    names = [c for c in rows.columns if c != "_bucket"]
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def best_two_fit(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place among sequences of at most ``capacity`` tokens."""
    return pack(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), capacity, id_col)
