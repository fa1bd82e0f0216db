"""The pipeline's stages against brute force, and the registered queries against their SQL."""

import os

import duckdb
import pytest
from test_llm_operators import brute_classes, kept_bytes, shingle_sets

import corpus_pipeline
from graphloom.llm import bpe, probminhash, quality, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark, docs, by_id):
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    kept = stages[0](spark, docs, None).cache()
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    one = stages[1](spark, kept, None).cache()
    sets = {i: s for i, s in shingle_sets(by_id).items() if i in good}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(brute_classes(sets).values())) and one.columns == docs.columns
    rest = stages[2](spark, one, None).cache()
    texts = {r.doc_id: r.text for r in rest.collect()}
    # exactly the bytes that brute force keeps, without parts of characters
    want = kept_bytes({i: by_id[i] for i in texts})
    assert rest.columns == docs.columns and texts == {i: b.decode("utf-8", "ignore") for i, b in want.items()}
    assert any(len(b) < len(by_id[i].encode()) for i, b in want.items())
    packed = stages[3](spark, rest, None).toPandas()
    assert set(packed.doc_id) == set(texts) and packed.groupby("sequence_id").length.sum().max() <= 4096
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), None).count() == 0


def test_rows_of_one_id(spark):
    """Of rows with one id one stays, the same one every time."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words), (1, words.replace("w", "x")), (2, words.replace("w", "y")), (2, words.replace("w", "y"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df.repartition(n), None).collect()) for n in (1, 3)]
    assert got[0] == got[1] and [i for i, _ in got[0]] == [1, 2]


def test_texts_of_one_id(spark):
    """Of an id with different texts one text counts; a copy of the other under another id stays, and columns may have any name."""
    base = " ".join(f"w{k}" for k in range(60))
    other = base.replace("w", "x")
    for swap in (False, True):
        a, b = (other, base) if swap else (base, other)
        rows = [(1, a, 1, 2, 3), (1, b, 1, 2, 3), (2, b, 1, 2, 3), (3, a, 1, 2, 3), (4, "", 1, 2, 3), (4, b + " y", 1, 2, 3), (None, a, 1, 2, 3)]
        df = spark.createDataFrame(rows, "doc_id long, text string, _n int, N int, n_ int")
        seen = set()
        for n in (1, 3, 5):
            kept = corpus_pipeline.near_dedup(spark, df.repartition(n), None)
            assert kept.columns == df.columns
            got = sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect())
            # one row of each id at most, and some copy of either text is left
            assert len(got) == len({i for i, _ in got}) and {t for _, t in got} >= {a, b}
            classes = probminhash.near_duplicates(df.repartition(n)).where("doc_id is not null").collect()
            assert len(classes) == 6 and len({(r.doc_id, r.class_id) for r in classes}) == 4
            seen.add((tuple(got), tuple(sorted((r.doc_id, r.class_id) for r in classes))))
        assert len(seen) == 1


@needs_tables
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id: r.text for r in docs.join(quality.judge(docs).where("kept").select("doc_id"), "doc_id").collect()}
    one = set(brute_classes(shingle_sets(good)).values())
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert set(rows.doc_id) == one and rows.groupby("sequence_id").length.sum().max() <= 4096
    codec = bpe.BpeCodec(bpe.vocabulary_path())
    texts = {i: b.decode("utf-8", "ignore") for i, b in kept_bytes({i: good[i] for i in one}).items()}
    for i, own in rows.groupby("doc_id"):
        assert own.length.sum() == len(codec.encode([texts[i]])[0]) + 1


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "conversations", "embeddings"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(queries.oracle_sql()[name]).df()
        columns = sorted(want.columns)
        rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
        assert sorted(got.columns) == columns and rows(got) == rows(want)
