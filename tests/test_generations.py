"""The incremental tables against one run over the newest records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, search
from graphloom.sources import records
from graphloom.streaming import generations, jobs


def hits(index, asked):
    return {(r.query_id, r.id, r.score) for r in search.search_index(index, asked).collect()}


def contents(tables):
    return {n: sorted(map(str, df.select(*(c for c in df.columns if c != "source_path")).collect())) for n, df in tables.items()}


def test_stream_of_records(spark, tmp_path):
    """Batches of new records, late ones and blank ones, as files."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(name, i, at, title, body="", **meta):
        (source / f"{name}.json").write_text(json.dumps({"id": i, "draft": {"type": "note", "title": title, "bodyMd": body, "jsonld": json.dumps(meta)}, "updatedAtUtc": at}))

    def run():
        jobs.run_incremental(spark, str(source), target, str(tmp_path / "cp")).awaitTermination()
        return generations.open_tables(spark, target)

    put(1, "a", "2024-01-02", "Fox", json.dumps([{"type": "paragraph", "content": "red fox"}]), projectId="p", referenceIds=["g"])
    put(2, "a", "2024-01-01", "Old")
    put(3, "b", "2024-01-01", "Hen", "hen house", collectionId="c")
    put(4, "c", "2024-01-01", "Owl", "night")
    t = run()
    assert {(r.id, r.title) for r in t["nodes"].collect()} == {("a", "Fox"), ("b", "Hen"), ("c", "Owl")}
    vector = {r.id: r.embedding for r in t["vectors"].collect()}
    put(5, "a", "2023-01-01", "Late", "late", projectId="late")
    put(6, "b", "2024-02-01", "Hen", "hen barn")
    put(7, "c", "2024-02-01", " ", " ")
    opened = contents(t)
    t = run()
    nodes = {r.id: r for r in t["nodes"].collect()}
    assert {i: (r.title, r.body_md) for i, r in nodes.items()} == {"a": ("Fox", "red fox paragraph"), "b": ("Hen", "hen barn"), "c": (" ", " ")}
    assert {(r.src_id, r.predicate, r.dst_id) for r in t["edges"].collect()} == {("a", "contains", "p"), ("g", "style-guides", "a")}
    assert {(r.term, r.id, r.tf) for r in t["postings"].collect()} == {("fox", "a", 2), ("red", "a", 1), ("paragraph", "a", 1), ("hen", "b", 2), ("barn", "b", 1)}
    now = {r.id: r.embedding for r in t["vectors"].collect()}
    # a blank text keeps the vector, a changed one has a new one
    assert now["c"] == vector["c"] and now["a"] == vector["a"] and now["b"] != vector["b"]
    asked = spark.createDataFrame([(1, "hen"), (2, "f")], "query_id long, query string")
    assert hits(generations.open_incremental_index(spark, target), asked) == hits(search.index_of(t["nodes"]), asked) != set()
    assert contents(generations.open_tables(spark, target)) != opened
    # the same batch under its number is left out; the same rows without one change nothing
    before, number = contents(t), generations.Manifest(spark, target).read()[0]
    again = records.read_records(spark, str(source), "canonical").groupBy("id").agg(F.max_by(F.struct("*"), "updated_at_utc").alias("r")).select("r.*")
    generations.update_tables(again, target, batch=0)
    assert generations.Manifest(spark, target).read()[0] == number
    generations.update_tables(again, target)
    assert contents(generations.open_tables(spark, target)) == before


def record(i, version):
    rnd = random.Random(f"{i}-{version}")
    words = " ".join(rnd.choice(["red", "fox", "hen", "barn", "owl", "night", "x1"]) for _ in range(rnd.randint(0, 8)))
    meta = json.dumps({k: rnd.choice(["p1", "p2"]) for k in ("projectId", "piId") if rnd.random() < 0.5} | {"referenceIds": [f"n{rnd.randrange(30)}"]})
    return (f"n{i}", "note", rnd.choice(["", "Title", "Big fox"]), words, meta, None, "canonical", f"2024-01-{version:02}", "f")


ROWS = "id string, type string, title string, body_md string, jsonld string, pi_id string, kind string, updated_at_utc string, source_path string"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_equals_a_rebuild(spark, tmp_path, seed):
    """Random versions in random batches, with deletions, compacted or not."""
    rnd, target = random.Random(seed), str(tmp_path / "out")
    newest: dict[str, tuple] = {}
    dead: dict[str, str] = {}
    sizes = []
    for _ in range(4):
        batch = [record(i, rnd.randint(1, 28)) for i in rnd.sample(range(40), rnd.randint(1, 12))]
        for r in batch:
            if r[7] >= max(newest.get(r[0], [""] * 8)[7], dead.get(r[0], "")):
                newest[r[0]] = r
                dead.pop(r[0], None)
        number, before = generations.Manifest(spark, target).read()
        generations.update_tables(spark.createDataFrame(batch, ROWS), target, compacts=seed == 1)
        added = [g for g in generations.Manifest(spark, target).read()[1]["generations"] if g not in before["generations"]]
        sizes.append((len(batch), added))
    gone = [(f"n{i}",) for i in range(0, 45, 3)]
    generations.delete_from_tables(spark.createDataFrame(gone, "id string"), target, "2024-01-15", compacts=False)
    for (i,) in gone:
        if i not in newest or newest[i][7] <= "2024-01-15":
            newest.pop(i, None)
            dead[i] = "2024-01-15"
    late = [record(0, 2), record(3, 28), record(1, 28)]
    for r in late:
        if r[7] >= max(newest.get(r[0], [""] * 8)[7], dead.get(r[0], "")):
            newest[r[0]] = r
    generations.update_tables(spark.createDataFrame(late, ROWS), target, compacts=False)
    full_target = str(tmp_path / "full")
    generations.update_tables(spark.createDataFrame(list(newest.values()), ROWS), full_target)
    asked = spark.createDataFrame([(1, "fox"), (2, "n"), (3, "red hen"), (4, "zzz")], "query_id long, query string")

    def same():
        got, want = (contents({k: v for k, v in generations.open_tables(spark, t).items() if k != "vectors"}) for t in (target, full_target))
        assert got == want
        index, rebuilt = generations.open_incremental_index(spark, target), search.index_of(generations.open_tables(spark, target)["nodes"])
        assert tuple(index.stats.first()) == tuple(rebuilt.stats.first())
        assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, rebuilt.terms.collect()))
        assert hits(index, asked) == hits(rebuilt, asked) != set()
        # opening the statistics reads no postings
        assert "postings" not in index.stats._jdf.queryExecution().toString() + index.terms._jdf.queryExecution().toString()

    same()
    listed = generations.Manifest(spark, target).read()[1]["generations"]
    if seed == 2:
        # a batch has written its own rows and nothing else
        assert all(len(added) <= 1 and all(g["size"] <= n for g in added) for n, added in sizes) and len(listed) > 4
    # a writer that failed has left files that nobody lists
    spark.range(3).write.parquet(f"{target}/generation-lost/nodes")
    generations.compact(spark, target, everything=True)
    assert len(generations.Manifest(spark, target).read()[1]["generations"]) == 1
    same()
    generations.Manifest(spark, target).vacuum(keep=1)
    assert sum(p.name.startswith("generation-") for p in (tmp_path / "out").iterdir()) == 1
    same()
    with pytest.raises(RuntimeError):
        generations.Manifest(spark, target).commit(generations.Manifest(spark, target).read()[0], {})


def test_generations_stay_few():
    """Sizes after many batches: a logarithmic number of generations, and few rewrites of each row."""
    rnd = random.Random(3)
    sizes, rewritten, total = [], 0, 0
    for _ in range(2000):
        sizes.append(rnd.randint(1, 20))
        total += sizes[-1]
        first = generations.run_to_merge(sizes)
        if first is not None:
            rewritten += sum(sizes[first:])
            sizes = [*sizes[:first], sum(sizes[first:])]
        assert len(sizes) <= 16 and generations.run_to_merge(sizes) is None
    assert rewritten < 16 * total


def test_edges_of_stored_nodes(spark, tmp_path):
    """An edge that two nodes state is one edge, and stays while one of them states it."""
    target = str(tmp_path / "out")
    row = lambda i, at, **meta: (i, "note", "t", "b", json.dumps(meta), None, "canonical", at, "f")
    generations.update_tables(spark.createDataFrame([row("a", "1", projectId="p"), row("b", "1", referenceIds=["a"])], ROWS), target)
    generations.update_tables(spark.createDataFrame([row("b", "2")], ROWS), target)
    got = generations.open_tables(spark, target)["edges"].select(*graph.KEY)
    assert [tuple(r) for r in got.collect()] == [("a", "contains", "p")]
