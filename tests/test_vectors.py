"""The stored vector index against all distances."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import search, vectors
from graphloom.session import fresh


def all_distances(rows, queries, k):
    """``{(query_id, id, dist)}`` of the nearest ``k``, by every distance."""
    out = set()
    ids = [i for i, v in rows]
    for qid, q in queries:
        own = sorted((float(np.round(np.sqrt(((np.array(v, float) - np.array(q, float)) ** 2).sum()), 9)), i) for i, v in zip(ids, (v for _, v in rows)) if len(v) == len(q))
        out |= {(qid, i, d) for d, i in own[:k]}
    return out


@pytest.fixture
def small(monkeypatch):
    for name, value in (("VECTORS", 50), ("QUERIES", 8), ("SPAN", 3), ("SAMPLE", 60), ("PIVOTS", 10)):
        monkeypatch.setattr(vectors, name, value)


@pytest.mark.parametrize("k", [1, 7, 150])
def test_nearest_of_many(spark, small, k):
    """Clusters, equal vectors of many rows, ties between ids, two dimensions, and rows that take no part."""
    rnd = np.random.default_rng(k)
    centres = rnd.normal(size=(6, 8)) * 5
    rows = [(f"n{i:04}", (centres[i % 6] + rnd.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(400)]
    rows += [(f"m{i:04}", [1.0] * 8) for i in range(260)] + [(f"t{i:03}", [float(i % 5), 2.0]) for i in range(90)]
    bad = [(None, [1.0] * 8), ("x", None), ("y", [1.0] * 7 + [None]), ("z", [float("nan")] * 8), ("w", [float("inf")] * 8)]
    df = spark.createDataFrame(rows + bad, "id string, embedding array<float>").repartition(5)
    queries = [(i, rows[i * 13 % len(rows)][1]) for i in range(50)] + [(90, [1.0] * 8), (91, [0.0] * 8), (92, [3.0, 2.0])]
    asked = spark.createDataFrame(queries + [(93, None), (None, [1.0] * 8), (94, [1.0, None]), (95, [1.0])], "query_id long, vector array<float>")
    index = vectors.store_vectors(df, fresh(spark, "test"))
    blocks = index.blocks.collect()
    # every vector lies in one block, and equal ones are cut too
    assert sum(b.n for b in blocks) == len(rows) and max(b.n for b in blocks) <= 50
    files = len(os.listdir(index.path.removeprefix("file://") + "/files"))
    found = search.search_vectors(index, asked, k)
    got = [(r.query_id, r.id, r.dist) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == all_distances(rows, queries, k)
    # a search adds no copy of a vector, and its plan reads names of blocks only
    assert len(os.listdir(index.path.removeprefix("file://") + "/files")) == files
    assert "embedding" not in found._jdf.queryExecution().toString()
    # of vectors without an index: the same for many, and for one as a constant
    assert {(r.query_id, r.id, r.dist) for r in search.search_vectors(df, asked, k).collect()} == set(got)
    one = search.search_vectors(df, asked.where("query_id = 90"), k)
    assert {(r.query_id, r.id, r.dist) for r in one.collect()} == {g for g in got if g[0] == 90}
    again = vectors.open_vectors(spark, index.path)
    assert {(r.query_id, r.id, r.dist) for r in search.search_vectors(again, asked, k).collect()} == set(got)


def test_blocks_that_cannot_win_stay_closed():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 16)) * 10
    data = [c + rnd.normal(size=(100, 16)) * 0.05 for c in centres]
    blocks = []
    for p, own in enumerate(data):
        far = np.sqrt(((own - centres[p]) ** 2).sum(axis=1))
        blocks.append((p, float(far.min()), float(far.max())))
    opened = []

    def load(b):
        opened.append(b)
        return np.array([f"{b}-{i:03}" for i in range(100)], object), data[b]

    queries = np.vstack([data[3][:5], data[4][:5]])
    best = vectors.nearest(queries, 10, centres, np.zeros((0, 16)), blocks, load)
    assert sorted(opened) == [3, 4] and all(i.startswith("3-") for i in best.ids[0])
    # with a sample the search begins below the k-th distance of the sample, and misses none
    opened.clear()
    near = vectors.nearest(queries[:2], 10, centres, np.vstack(data)[::7], blocks, load)
    assert opened == [3]
    gap = np.sqrt(((data[3] - queries[0]) ** 2).sum(axis=1))
    assert sorted(near.dist[0].tolist()) == np.round(np.sort(gap)[:10], 9).tolist()


def test_index_of_nothing_and_of_integer_ids(spark, small):
    empty = spark.createDataFrame([], "id string, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "query_id long, vector array<float>")
    assert search.search_vectors(vectors.store_vectors(empty, fresh(spark, "test")), asked, 5).count() == 0
    assert search.search_vectors(empty, asked.limit(0), 5).count() == 0
    rows = [(i, [float(i % 10), 0.5]) for i in range(200)]
    index = vectors.store_vectors(spark.createDataFrame(rows, "id long, embedding array<double>"), fresh(spark, "test"))
    assert search.search_vectors(index, asked.where(F.lit(False)), 5).count() == 0
    got = {(r.query_id, r.id, r.dist) for r in search.search_vectors(index, asked, 12).collect()}
    assert got == all_distances(rows, [(i, [float(i), 1.0]) for i in range(3)], 12)
