"""What a query holds, exchanges or stores keeps in step with its input."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions import batches, blocks
from graphloom.functions.text import tokens
from graphloom.operators import bodies, search, statechart
from graphloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_a_narrow_map(spark):
    nodes = spark.createDataFrame([("a", "One", "two one"), ("b", None, None), ("c", "", "Two")], "id string, title string, body_md string")
    assert "Exchange" not in _plan(search.postings(nodes))
    assert {tuple(r) for r in search.postings(nodes).collect()} == {("one", "a", 2, 3), ("two", "a", 1, 3), ("two", "c", 1, 1)}


def test_rows_of_one_id_are_one_node(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "One", "two"), ("a", None, "one"), ("c", "", "Two")], "id string, title string, body_md string")
    assert {tuple(r)[:3] for r in search.postings(nodes).collect()} == {("one", "a", 2), ("two", "a", 1), ("two", "c", 1)}
    index = search.store_index(nodes, str(tmp_path / "index"))
    assert {tuple(r) for r in index.terms.collect()} == {("one", 1), ("two", 2)}
    assert sorted(r.id for r in index.ids.collect()) == ["a", "c"]


def test_words_are_counted_once_for_all_edges(spark):
    rows = spark.createDataFrame([("a b c",), ("a",), ("",)], "body string").select(F.size(tokens(F.col("body"))).cast("long").alias("dl"))
    df = rows.select("dl", search._group(F.col("dl"), [1, 2, 3, 9]).alias("g"))
    assert {tuple(r) for r in df.collect()} == {(3, 3), (1, 1), (0, 0)}
    plan = df.select("g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "split(" not in plan[plan.index("<= ") :]


def test_hits_are_scored_where_their_node_is(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", None, f"red {'fox ' * (i % 3)}w{i}") for i in range(50)], "id string, title string, body_md string")
    queries = spark.createDataFrame([(1, "red fo"), (2, "w1"), (3, "nowhere red")], "query_id long, query string")
    hits = search.search_index(search.store_index(nodes, str(tmp_path / "index")), queries)
    assert "Exchange hashpartitioning" not in _plan(hits)
    assert {(r.query_id, r.id) for r in hits.collect()} == {(1, f"n{i}") for i in range(50) if i % 3} | {(2, f"n{i}") for i in (1, *range(10, 20))}


@pytest.mark.parametrize("name", ["r13_corpus_stats", "r13_term_stats", "j1_postings_join"])
def test_statistics_store_no_index(spark, monkeypatch, name):
    def stored(*_):
        raise AssertionError("an index was stored")

    monkeypatch.setattr(search, "store_index", stored)
    monkeypatch.setattr("graphloom.plans.kb.store_index", stored)
    monkeypatch.setattr("graphloom.plans.kb._STORED", {})
    assert QUERIES[name](spark, SF).count()


@pytest.mark.parametrize("listing", [statechart.scenarios, statechart.feature_text, statechart.integrity, statechart.export_transitions, statechart.layer_rank])
def test_charts_are_not_broadcast(spark, listing):
    charts = spark.createDataFrame([(1, "a --> b : GO\nb --> b : STAY"), (2, "[*] --> a\na --> b : GO")], "doc_id long, text string")
    moves = statechart.import_transitions(charts)
    out = listing(statechart.states_of(moves), statechart.edges_of(moves))
    assert "Broadcast" not in _plan(out) and out.count() >= 0


def test_python_takes_few_texts_at_once(spark, monkeypatch):
    monkeypatch.setattr(batches, "PIECE", 100)
    texts = ["x" * n for n in (30, 90, 0, 500, 10)] + [None, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    got = list(batches.pieces(iter([batch, batch.slice(0, 0)])))
    assert [len(b) for b in got] == [2, 2, 3] and pa.Table.from_batches(got).column(1).to_pylist() == texts
    held = []
    monkeypatch.setattr(batches, "cuts", lambda t, f=batches.cuts: held.extend(f(t)) or iter(held))
    assert batches.mapped(lambda t: t and t[:1], batch.column(1), pa.string()).to_pylist() == ["x", "x", "", "x", "x", None, "y"] and len(held) == 3


@pytest.mark.parametrize(("name", "texts"), [("p1_searchable_text", [None, " ", "a\nb"]), ("p2_plain_text", [None, "", " \n", " a\n b "]), ("p3_first_text", [None, "", " \n", " a\n b "])])
def test_texts_without_words(spark, tmp_path, name, texts):
    spark.createDataFrame([(k, t, "src0") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(SQL[name]).fetchall()}
    assert {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()} == want
