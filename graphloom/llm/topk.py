"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks once. Each block is stored in the shared folder with the
order of its values in every dimension, and so are blocks of queries; nothing is copied per
query block. A task takes one block of queries through a span of candidate blocks, which it
maps into memory. A query walks all lists of a block at once from their best end, deeper by
steps: every vector that a list shows for the first time is scored in full, and the walk ends
as soon as the sum of the values now at the lists' heads, weighted by the query, is below the
query's k-th score so far. That score is carried from block to block of the span, so a block
that cannot beat it is left at its heads. A last window keeps each query's k best over the spans.

Defined results: components become ``floor(scale * x)`` and scores are exact integers, however
large (vectors with components beyond 2^20 are scored by Python's integers); a score beyond a
long ranks as it is and is reported as the nearest long. Vectors that are null, or hold a null
or non-finite component, and rows without an id take no part; ties go to the smaller id; a
query never finds its own row; a query meets vectors of its own dimension only; rows with the
same id are separate candidates of one id, and all of them are the query's own when that id
asks, which it does once, with its smallest vector. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import fresh, map_file, mounted, put_file, written
from graphloom.session import reach_workers

#: Vectors in a candidate block and in a query block, and candidate blocks in the span of a task.
CANDIDATES, QUERIES, SPAN = 4096, 4096, 64
#: Components up to this size are scored in doubles, which are then exact.
LARGE = 1 << 20


class Block:
    """A stored block of candidates of one dimension: ids in order, scaled vectors, and every dimension's order."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, scale: int, order: np.ndarray | None = None):
        self.ids, self.raw, self.scale = ids, raw, scale
        self.vectors = np.floor(raw * float(scale))
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32) if order is None else order
        self.heads = np.take_along_axis(self.vectors, self.order, axis=0)
        self.is_large = bool(np.abs(self.vectors).max(initial=0) > LARGE)

    def exact(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Scaled vectors as Python's integers."""
        return exact(self.raw[rows], self.scale)


def exact(raw: np.ndarray, scale: int) -> np.ndarray:
    out = np.empty(raw.shape, object)
    for at, x in np.ndenumerate(raw):
        y = float(x) * scale
        out[at] = math.floor(y) if math.isfinite(y) else math.floor(Fraction(float(x)) * scale)
    return out


def best_of(at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest scores; places follow ids, so the earlier place wins a tie."""
    top = np.lexsort((at, -score))[:k]
    return at[top], score[top]


def walk(block: Block, q: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the block's ``k`` best for one query, exact among those of at least ``floor``."""
    n, dims = block.vectors.shape
    use = np.flatnonzero(q)
    falling = q[use] > 0  # these lists are read from the large end
    order, heads = block.order, block.heads
    seen = np.zeros(n, bool)
    kept_at, kept_score = np.zeros(0, np.int64), np.zeros(0)
    done, depth = 0, 64
    while done < n:
        worst = max(floor, kept_score.min() if len(kept_at) == k else -math.inf)
        if worst > -math.inf and float(np.where(falling, heads[n - 1 - done, use], heads[done, use]) @ q[use]) < worst:
            break
        depth = min(n, depth) if len(use) else n
        if len(use):
            rows = np.arange(done, depth)
            found = np.where(falling[None, :], order[n - 1 - rows][:, use], order[rows][:, use]).ravel()
            new = np.zeros(n, bool)
            new[found] = True
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
        else:
            at = np.arange(n)
        at = at[block.ids[at] != own]
        kept_at, kept_score = best_of(np.concatenate([kept_at, at]), np.concatenate([kept_score, block.vectors[at] @ q]), k)
        done, depth = depth, depth * 2
    return kept_at, kept_score


def threshold_search(blocks: Iterator[Block], raw: np.ndarray, query_ids: np.ndarray, scale: int, k: int) -> list[tuple[int, int, int]]:
    """``(query_id, id, score)`` of each query's ``k`` best among the blocks, exactly."""
    queries = np.floor(raw * float(scale))
    small = np.abs(queries).max(axis=1, initial=0) <= LARGE
    found: list[list[tuple[int, int]]] = [[] for _ in query_ids]  # (score, id), the best first
    for block in blocks:
        fast = not block.is_large and len(block.ids) and queries.shape[1] * LARGE * LARGE < 1 << 53
        whole = None
        for j, own in enumerate(query_ids.tolist()):
            held = found[j]
            if fast and small[j]:
                floor = float(held[-1][0]) if len(held) == k else -math.inf
                at, score = walk(block, queries[j], own, k, floor)
                new = zip(score.tolist(), block.ids[at].tolist())
            else:
                whole = block.exact() if whole is None else whole
                score = whole @ exact(raw[j], scale) if raw.shape[1] else np.zeros(len(block.ids), object)
                new = ((s, i) for s, i in zip(score, block.ids.tolist()) if i != own)
            found[j] = sorted(held + [(int(s), i) for s, i in new], key=lambda x: (-x[0], x[1]))[:k]
    return [(own, i, s) for own, held in zip(query_ids.tolist(), found) for s, i in held]


def _sortable(score: int) -> str:
    """A text that sorts as the number does, however many digits it has."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + "".join(str(9 - int(c)) for c in digits)


def _store_blocks(rows: DataFrame, folder: str, kind: str, scale: int, ordered: bool) -> None:
    """Write each block ``(dim, wide, block)`` of ``rows`` as files: ids, and vectors with their orders."""

    def put(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        dim, wide, block = (x.as_py() for x in key)
        ids = group.column("id").to_numpy()
        raw = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        # rows of one id in order of their vectors, so that a repeated task writes the same
        by = np.lexsort((*raw.T[::-1], ids))
        ids, raw = ids[by], raw[by]
        name = f"{folder}/{kind}-{dim}-{int(wide)}-{block}"
        put_file(f"{name}-ids", ids)
        if ordered:
            put_file(name, raw.ravel(), Block(ids, raw, scale).order.ravel())
        else:
            put_file(name, raw.ravel())
        return pa.table({"n": pa.array([len(ids)], pa.int64())})

    rows.groupBy("dim", "wide", "block").applyInArrow(put, "n long").agg(F.sum("n")).collect()


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` best vectors of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    reach_workers(spark)
    good = F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(good)
    # vectors with large components lie in blocks of their own, so that they slow no others down
    rows = written(rows.withColumn("dim", F.size("v")).withColumn("wide", F.exists("v", lambda x: F.abs(x) * scale > LARGE - 1)), "vectors")
    queries = written(rows.where("asks").groupBy("dim", "id").agg(F.min("v").alias("v")), "queries")
    # rows are dealt by where they lie, so that copies of one id are not a block of their own
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    asked = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_blocks"))
    # one small row per dimension and kind of vector
    sizes = written(rows.groupBy("dim", "wide").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("c_blocks")).join(asked, "dim"), "sizes")
    folder = mounted(fresh(spark, "lists"))
    block = lambda df, n: df.select("dim", "id", "v", "wide", F.pmod("_deal", n).cast("int").alias("block"))
    _store_blocks(block(rows.withColumn("_deal", place).join(sizes, ["dim", "wide"]), F.col("c_blocks")), folder, "c", scale, True)
    _store_blocks(block(queries.withColumn("_deal", place).withColumn("wide", F.lit(False)).join(asked, "dim"), F.col("q_blocks")), folder, "q", scale, False)
    total = sizes.agg(F.coalesce(F.sum(F.col("c_blocks").cast("long") * F.col("q_blocks")), F.lit(0))).first()[0]
    cores = spark.sparkContext.defaultParallelism
    span = max(1, min(SPAN, total // (4 * cores)))
    first = F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1, F.lit(span))).alias("low")
    tasks = sizes.select("dim", "wide", "c_blocks", "q_blocks", first).select("dim", F.col("wide").cast("int").alias("wide"), "low", F.least(F.col("low") + span, "c_blocks").alias("high"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(kind: str, dim: int, wide: int, at: int, *types) -> tuple[np.ndarray, ...]:
            name = f"{folder}/{kind}-{dim}-{wide}-{at}"
            (ids,) = map_file(f"{name}-ids", (np.int64,))
            return ids, *(np.asarray(x).reshape(len(ids), dim) for x in map_file(name, types))

        for batch in batches:
            for dim, wide, low, high, at in zip(*(batch.column(c).to_pylist() for c in ("dim", "wide", "low", "high", "q_block"))):
                asked, raw = read("q", dim, 0, at, np.float64)

                def blocks() -> Iterator[Block]:
                    for c in range(low, high):
                        ids, own, order = read("c", dim, wide, c, np.float64, np.int32)
                        yield Block(ids, own, scale, order)

                found = threshold_search(blocks(), raw, asked, scale, k)
                clip = [max(-(1 << 63), min((1 << 63) - 1, f[2])) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array(clip, pa.int64()), pa.array([_sortable(f[2]) for f in found], pa.string())], ["query_id", "id", "score", "key"])

    many = max(1, min(10_000, -(-total // span)))
    found = tasks.repartition(many, F.xxhash64("dim", "wide", "low", "q_block")).mapInArrow(run, "query_id long, id long, score long, key string")
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
