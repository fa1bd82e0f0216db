"""A stored vector index: blocks of near vectors with their distances from a pivot, searched by the triangle inequality.

Vectors are written once. Each goes to its nearest pivot (pivots are a bounded sample of the
vectors, and zero, from which the distance is the norm) and is range-partitioned by (pivot, distance), so a block is a ring
around its pivot and a frequent pivot or a vector that many rows share is cut into many blocks.
A small table names the blocks with their rings.

A search deals blocks of queries against spans of blocks. A task orders the blocks of its span
by how near their rings come to its queries and keeps each query's k-th distance. A block is
opened only for queries whose distance to the ring is not beyond that, and
no vector is shuffled or copied for a block of queries. The k-th distance to the sample is where every task begins.

Distances are Euclidean, rounded to nine decimals; ties go to the smaller id. Vectors and
queries without an id, or that are null or hold a null or a number that is not finite, take no part; a query meets vectors of its own
dimension. Rows of one id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.files import read_file, write_file
from graphloom.session import fresh, reach_workers

#: Vectors of a block, queries of a block, blocks that a task takes, sampled vectors, and pivots of a dimension.
VECTORS, QUERIES, SPAN, SAMPLE, PIVOTS = 4096, 1024, 64, 4096, 256
#: What rounding may change in a distance; bounds give way by so much.
SLACK = 2e-9


@dataclass(frozen=True)
class VectorIndex:
    """``blocks``: ``dim, name, n, pivot, low, high``, one row for each stored block; ``samples``: ``dim, name, pivots`` of the sampled vectors."""

    path: str
    blocks: DataFrame
    samples: dict[int, str]
    id_type: str


def rows_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v, dim)`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))").withColumn("dim", F.size("v"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of two matrices, to within rounding."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def store_vectors(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding") -> VectorIndex:
    """Write the index below ``path``, a folder that all workers share, and open it."""
    spark = vectors.sparkSession
    reach_workers(spark)
    rows = rows_of(vectors, id_col, vector_col)
    # a bounded sample, the same each time
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    pivots = {dim: np.vstack([np.zeros((1, dim)), np.array(own[:PIVOTS], np.float64).reshape(-1, dim)]) for dim, own in sample.items()}
    names = [(dim, write_file(f"{path}/files", pa.table({"v": pa.array(own, pa.list_(pa.float64())), "is_pivot": [i < PIVOTS for i in range(len(own))]}))) for dim, own in sample.items()]
    spark.createDataFrame(names, "dim int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/samples")
    rows.select("id").limit(0).write.mode("overwrite").parquet(f"{path}/ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, pivot, far = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                v, p = matrix(batch.column(1).take(pa.array(at)), dim), pivots.get(dim, np.zeros((1, dim)))
                best = gaps(v, p).argmin(axis=1)
                pivot[at], far[at] = best, np.sqrt(((v - p[best]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far)], ["id", "v", "dim", "pivot", "far"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"id {kind}, v array<double>, dim int, pivot int, far double")
    order = ["dim", "pivot", "far", "id"]
    _cut(placed.repartitionByRange(*order).sortWithinPartitions(*order), ["dim", "pivot"], VECTORS, f"{path}/files").write.mode("overwrite").parquet(f"{path}/blocks")
    return open_vectors(spark, path)


def open_vectors(spark: SparkSession, path: str) -> VectorIndex:
    """The index of :func:`store_vectors`."""
    samples = {r["dim"]: r["name"] for r in spark.read.parquet(f"{path}/samples").collect()}
    return VectorIndex(path, spark.read.parquet(f"{path}/blocks"), samples, spark.read.parquet(f"{path}/ids").schema["id"].dataType.simpleString())


def _cut(ordered: DataFrame, by: list[str], most: int, folder: str) -> DataFrame:
    """Write runs of at most ``most`` rows that agree in ``by`` as files: ``dim, name, n, pivot, low, high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def put() -> pa.RecordBatch:
            own = pa.concat_tables(held).combine_chunks()
            held.clear()
            far = own.column("far").to_numpy()
            row = {"dim": own.column("dim")[0].as_py(), "name": write_file(folder, own.select(["id", "v"])), "n": len(own), "pivot": own.column("pivot")[0].as_py(), "low": float(far.min()), "high": float(far.max())}
            return pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("name", pa.string()), ("n", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table.column(c).to_numpy() for c in by])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(table)]):
                while a < b:
                    if held and any(held[0].column(c)[0] != table.column(c)[a] for c in by):
                        yield put()
                    room = most - sum(map(len, held))
                    held.append(table.slice(a, min(b - a, room)))
                    a += len(held[-1])
                    if sum(map(len, held)) >= most:
                        yield put()
        if held:
            yield put()

    return ordered.mapInArrow(run, "dim int, name string, n long, pivot int, low double, high double")


class Best:
    """The ``k`` nearest of each query so far: distances as reported, and ids."""

    def __init__(self, queries: np.ndarray, k: int, bound: np.ndarray):
        self.queries, self.k, self.bound = queries, k, bound
        self.dist = [np.zeros(0) for _ in queries]
        self.ids = [np.zeros(0, object) for _ in queries]

    def offer(self, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Take the vectors that are among the ``k`` nearest of the queries at ``rows``."""
        about = gaps(self.queries[rows], vectors)
        # rounding of a difference of large squares
        unsure = 1e-7 * (1 + np.abs(self.queries[rows]).max(axis=1, initial=0) + np.abs(vectors).max(initial=0)) * np.sqrt(max(1, vectors.shape[1]))
        limit = self.bound[rows] + unsure + SLACK
        if len(ids) > self.k:
            limit = np.minimum(limit, np.partition(about, self.k - 1, axis=1)[:, self.k - 1] + 2 * unsure + SLACK)
        for row, near in zip(rows.tolist(), about <= limit[:, None]):
            at = np.flatnonzero(near)
            if len(at):
                dist = np.concatenate([self.dist[row], np.round(np.sqrt(((vectors[at] - self.queries[row]) ** 2).sum(axis=1)), 9)])
                names = np.concatenate([self.ids[row], ids[at]])
                if len(dist) > self.k:
                    kth = np.partition(dist, self.k - 1)[self.k - 1]
                    inner, tied = np.flatnonzero(dist < kth), np.flatnonzero(dist == kth)
                    if len(inner) + len(tied) > self.k:
                        tied = tied[np.argsort(names[tied], kind="stable")][: self.k - len(inner)]
                    keep = np.concatenate([inner, tied])
                    dist, names = dist[keep], names[keep]
                self.dist[row], self.ids[row] = dist, names
                if len(dist) == self.k:
                    self.bound[row] = min(self.bound[row], dist.max())


def nearest(queries: np.ndarray, k: int, pivots: np.ndarray, sample: np.ndarray, blocks: list[tuple[int, float, float]], load: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> Best:
    """Each query's ``k`` nearest among blocks ``(pivot, low, high)``; ``load`` opens one, giving its ids and vectors."""
    bound = np.full(len(queries), np.inf)
    if len(sample) >= k:
        bound = np.partition(gaps(queries, sample), k - 1, axis=1)[:, k - 1] + 1e-6 * (1 + np.abs(queries).max(axis=1, initial=0) + np.abs(sample).max(initial=0))
    best = Best(queries, k, bound)
    pivot, low, high = (np.array([b[i] for b in blocks]) for i in range(3))
    to_pivot = np.stack([np.sqrt(((queries - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
    ring = np.maximum(np.maximum(to_pivot[:, pivot] - high, low - to_pivot[:, pivot]), 0)
    for b in np.argsort(ring.min(axis=0), kind="stable").tolist():
        rows = np.flatnonzero(ring[:, b] <= best.bound + SLACK + 1e-12 * (1 + to_pivot[:, pivot[b]]))
        if len(rows):
            ids, vectors = load(b)
            best.offer(rows, vectors, ids)
    return best


def search_blocks(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, dist)``: the nearest ``k`` of each query ``(query_id, vector)``."""
    spark = queries.sparkSession
    reach_workers(spark)
    folder, samples, files = fresh(spark, "vector-queries"), index.samples, f"{index.path}/files"
    asks = rows_of(queries, "query_id", "vector").withColumns({"pivot": F.lit(0), "far": F.lit(0.0)})
    asked = _cut(asks.repartitionByRange("dim", "id").sortWithinPartitions("dim", "id"), ["dim"], QUERIES, folder)
    asked = asked.select("dim", F.col("name").alias("asked"))
    asked.write.parquet(f"{folder}/blocks")
    asked = spark.read.parquet(f"{folder}/blocks")
    # both counts are of blocks
    n_blocks, n_asked = index.blocks.count(), asked.count()
    span = max(1, min(SPAN, n_blocks * n_asked // (4 * spark.sparkContext.defaultParallelism)))
    spans = max(1, -(-n_blocks // span))
    held = index.blocks.withColumn("span", F.pmod(F.xxhash64("name"), F.lit(spans)).cast("int")).groupBy("dim", "span").agg(F.collect_list(F.struct("name", "pivot", "low", "high")).alias("blocks"))
    tasks = held.join(asked, "dim").repartition(max(1, min(10_000, spans * n_asked)), F.xxhash64("dim", "span", "asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                dim, blocks = task["dim"], task["blocks"]
                own = read_file(folder, task["asked"])
                sample, pivots = np.zeros((0, dim)), np.zeros((1, dim))
                if dim in samples:
                    stored = read_file(files, samples[dim])
                    sample = matrix(stored.column("v"), dim)
                    pivots = np.vstack([pivots, sample[stored.column("is_pivot").to_numpy(zero_copy_only=False)]])

                def load(b: int) -> tuple[np.ndarray, np.ndarray]:
                    block = read_file(files, blocks[b]["name"])
                    return block.column("id").to_pandas().to_numpy(object), matrix(block.column("v"), dim)

                best = nearest(matrix(own.column("v"), dim), k, pivots, sample, [(b["pivot"], b["low"], b["high"]) for b in blocks], load)
                rows = np.repeat(np.arange(len(own)), [len(d) for d in best.dist])
                yield pa.RecordBatch.from_arrays(
                    [own.column("id").combine_chunks().take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0, object), *best.ids]).tolist(), id_type), pa.array(np.concatenate([np.zeros(0), *best.dist]))], ["query_id", "id", "dist"]
                )

    kind = queries.schema["query_id"].dataType.simpleString()
    id_type = _arrow(index.id_type)
    found = tasks.mapInArrow(run, f"query_id {kind}, id {index.id_type}, dist double")
    best = Window.partitionBy("query_id").orderBy("dist", "id")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))
