"""Lexical search over block maxima against all scores."""

import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.operators import search
from graphloom.sources import records
from test_operators import brute_bm25


@pytest.mark.parametrize(("named", "limit"), [(64, 7), (2, 25)])
def test_first_hits_read_few_blocks(spark, tmp_path, monkeypatch, named, limit):
    for name, value in (("BLOCK", 10), ("LENGTHS", 16), ("NAMED", named), ("DEEP", 4), ("SMALL", 0)):
        monkeypatch.setattr(search, name, value)
    rnd = random.Random(5)
    # lengths and counts that differ widely, ties among equal texts, words longer than the counted prefixes
    words = ["fox", "foxes", "foxtrot", "red", "reading", "the", "zebra", "extraordinary"] + [f"w{k}" for k in range(60)]
    rows = [(f"n{i:04}", rnd.choice([None, "Red fox"]) if i % 9 == 0 else None, " ".join(rnd.choices(words, [9, 3, 1, 6, 2, 30, 1, 2] + [1] * 60, k=int(2 + 300 * rnd.random() ** 4)))) for i in range(900)]
    rows += [(f"t{i:04}", "", "fox the red") for i in range(40)]
    nodes = spark.createDataFrame(rows, "id string, title string, body_md string")
    asked = ["fox", "the red", "fo re", "zebra", "extraordin", "extraordinary fox", "nowhere", "w1 w2 the", "", "t"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = search.store_index(nodes, str(tmp_path / "index"))
    assert index.blocks.select("block").distinct().count() > 50
    stored, seen = search.written, {}

    def written(df, kind):
        seen.setdefault(kind, []).append(out := stored(df, kind))
        return out

    monkeypatch.setattr(search, "written", written)
    got = {}
    for r in search.search_index(index, queries, limit).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    for q, text in enumerate(asked):
        best = {i: -s for s, i in sorted((-round(x, 9), i) for i, x in brute_bm25(rows, text).items())[:limit]}
        found = got.get(q, {})
        assert found.keys() == best.keys() and all(abs(found[i] - best[i]) < 1e-8 for i in best)
    if limit == 7:
        # of words that are neither rare nor everywhere most blocks stay unread
        bounds = {r[0]: r[1] for r in seen["bounds"][0].groupBy("query_id").count().collect()}
        opened = {r[0]: r[1] for r in seen["open"][0].unionByName(seen["open"][1]).groupBy("query_id").count().collect()}
        assert all(bounds[q] > 60 and opened[q] + search.STEPS[0] < 0.25 * bounds[q] for q in (3, 4))
        assert sum(opened.values()) < 0.5 * sum(bounds.values())
    if named == 2:
        return
    full = {(r.query_id, r.id): r.score for r in search.search_index(index, queries).collect()}
    want = {(q, i): x for q, t in enumerate(asked) for i, x in brute_bm25(rows, t).items()}
    assert full.keys() == want.keys() and all(abs(full[k] - want[k]) < 1e-8 for k in want)



def test_counts_of_prefixes(spark, tmp_path):
    rows = [("a", "One", "ones on"), ("b", None, "one"), ("c", "", "ON o"), ("d", None, None)]
    index = search.store_index(spark.createDataFrame(rows, "id string, title string, body_md string"), str(tmp_path / "index"))
    assert {r.prefix: r.df for r in index.prefixes.collect()} == {"o": 3, "on": 3, "one": 2, "ones": 1}
    empty = search.store_index(spark.createDataFrame([], "id string, title string, body_md string"), str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "one")], "query_id long, query string")
    assert search.search_index(empty, asked, 5).count() == 0 and search.search_index(empty, asked).count() == 0


@pytest.mark.parametrize("small", [0, 100])
def test_saved_index_has_all_tables(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(search, "SMALL", small)
    nodes = spark.createDataFrame([("a", "note", "One", "ones on"), ("b", "pdf", None, "one"), ("c", "pdf", "", "ON")], "id string, type string, title string, body_md string")
    records.save_index(nodes, spark.createDataFrame([("a", "cites", "b")], "src_id string, predicate string, dst_id string"), spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>"), str(tmp_path / "saved"))
    rows = lambda what: spark.read.parquet(str(tmp_path / "saved" / what))
    assert [rows(w).count() for w in ("nodes", "edges", "vectors", "postings")] == [3, 1, 1, 5]
    assert {r.term: r.df for r in rows("terms").collect()} == {"one": 2, "ones": 1, "on": 2}


def test_blocks_are_scored_where_they_are_read(spark, tmp_path, monkeypatch):
    """The best hits with ties, hits among some nodes or pairs, and counts, over many blocks; weights are of all nodes."""
    rnd = random.Random(9)
    words = ["fox", "foxes", "red", "reading", "the", "zebra"]
    rows = [(f"n{i:03}", None, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(200)] + [(f"t{i:03}", "", "fox the red") for i in range(20)]
    nodes = spark.createDataFrame(rows, "id string, title string, body_md string").repartition(3, "id")
    asked = ["fox the", "re", "zebra fox", "nowhere", "", "the"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    want = {(q, i): x for q, t in enumerate(asked) for i, x in brute_bm25(rows, t).items()}

    def cut(batches):
        from graphloom.operators import search

        search.SHARE = 7
        return search._cut_lists(batches)

    monkeypatch.setattr(search, "_cut_lists", cut)
    index = search.store_index(nodes, str(tmp_path / "index"))
    assert index.lists.select("block").distinct().count() >= 220 // 7 and index.blocks is None
    got = {(r.query_id, r.id): r.score for r in search.search_index(index, queries).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    own = nodes.where("id like 'n%5'").select("id")
    best = lambda hits, n: {q: sorted(((-round(x, 9), i) for (p, i), x in hits.items() if p == q))[:n] for q in {k[0] for k in hits}}
    key = lambda df: {(r.query_id, r.id) for r in df.collect()}
    for hits, args in ((want, {}), ({k: x for k, x in want.items() if k[1][0] == "n" and k[1][-1] == "5"}, {"own": own})):
        assert key(search.search_index(index, queries, 5, **args)) == {(q, i) for q, b in best(hits, 5).items() for _, i in b}
    assert key(search.search_index(index, queries, own=own)) == {k for k in want if k[1][0] == "n" and k[1][-1] == "5"}
    assert search.search_index(index, queries, own=own.limit(0)).count() == 0
    pairs = spark.createDataFrame([(0, "t003"), (0, "n000"), (1, "t001"), (2, "t001"), (9, "t001"), (5, "none")], "query_id long, id string")
    assert key(search.hits_among(index, queries, pairs)) == {k for k in want if k in {(0, "t003"), (0, "n000"), (1, "t001"), (2, "t001")}}
    assert {r.query_id: r.n for r in search.count_hits(index, queries).collect()} == {q: sum(k[0] == q for k in want) for q in {k[0] for k in want}}


def test_best_hits_drop_others_on_the_way():
    best = search.Best(pa.array(["a", "b"]), 2)
    search.HELD, kept = 3, search.HELD
    try:
        for ask, ids, score in (([0, 0], ["z", "y"], [1.0, 1.0]), ([0, 1], ["x", "q"], [1.0, 5.0]), ([0], ["w"], [0.5])):
            best.add(np.array(ask), pa.array(ids), np.array(score))
        assert best.least.tolist() == [1.0, -np.inf]
        assert [r for b in best.rows() for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] == [("a", "x", 1.0), ("a", "y", 1.0), ("b", "q", 5.0)]
    finally:
        search.HELD = kept
