"""The knowledge base as DataFrames, projected from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import uuid_of
from graphloom.operators.graph import Adjacency, derive_edges, open_adjacency, store_adjacency
from graphloom.operators.search import Index, open_index, store_index
from graphloom.operators.vectors import VectorIndex, open_vectors, store_vectors
from graphloom.session import fresh, table, written

COLUMNS = ["id", "type", "title", "body_md", "jsonld", "kind", "project_id", "collection_id", "pi_id", "reference_ids", "summary", "updated_at"]


def _key(kind: str, key) -> F.Column:
    return uuid_of(F.concat(F.lit(f"{kind}:"), key.cast("string")))


def _nodes(df: DataFrame) -> DataFrame:
    """Fill what a kind of node lacks, and build its metadata string."""
    kinds = {"reference_ids": "array<string>", "updated_at": "timestamp_ntz"}
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kinds.get(c, "string")))
    meta = F.struct(F.col("type").alias("@type"), F.col("title").alias("name"), F.col("project_id").alias("projectId"), F.col("collection_id").alias("collectionId"), F.col("pi_id").alias("piId"), F.col("reference_ids").alias("referenceIds"), "summary")
    return df.withColumn("jsonld", F.to_json(meta)).select(*COLUMNS)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return _nodes(r.select(_key("region", r.r_regionkey).alias("id"), F.lit("project").alias("type"), F.col("r_name").alias("title"), F.lit("").alias("body_md"), F.lit("canonical").alias("kind"), F.lit("2023-12-31").cast("timestamp_ntz").alias("updated_at")))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return _nodes(n.select(_key("nation", n.n_nationkey).alias("id"), F.lit("collection").alias("type"), F.col("n_name").alias("title"), F.lit("").alias("body_md"), F.lit("canonical").alias("kind"), _key("region", n.n_regionkey).alias("project_id"), F.lit("2023-12-31").cast("timestamp_ntz").alias("updated_at")))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, nation = table(spark, sf_dir, "documents"), table(spark, sf_dir, "nation")
    n = docs.count()
    d = F.col("doc_id")
    types = F.array(*map(F.lit, ["note", "docx", "slides", "pdf", "spreadsheet", "email", "image", "code"]))
    # nation is a dimension of 25 rows
    docs = docs.withColumn("nation", (d % 25).cast("int")).join(F.broadcast(nation.select(F.col("n_nationkey").alias("nation"), "n_regionkey")), "nation", "left")
    ref = lambda k: _key("doc", (d + k) % n)
    return _nodes(
        docs.select(
            _key("doc", d).alias("id"), F.get(types, (d % 8).cast("int")).alias("type"), F.concat("source", F.lit("-"), d.cast("string")).alias("title"), F.col("text").alias("body_md"),
            F.when(d % 4 == 0, "draft").otherwise("canonical").alias("kind"), _key("region", F.col("n_regionkey")).alias("project_id"),
            F.when(d % 5 != 0, _key("nation", F.col("nation"))).alias("collection_id"), F.when(d % 3 != 0, _key("pi", d % 7)).alias("pi_id"),
            F.when(d % 10 == 0, F.array(ref(1), ref(2))).alias("reference_ids"), F.when(d % 2 == 0, F.substring("text", 1, 80)).alias("summary"),
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("updated_at"),
        )
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return _nodes(p.select(_key("page", p.page_id).alias("id"), F.lit("url").alias("type"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("body_md"), F.lit("canonical").alias("kind"), _key("region", p.page_id % 5).alias("project_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(page_id as int))").alias("updated_at")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes: projects, collections, assets and pages."""
    parts = [f(spark, sf_dir) for f in (projects, collections, assets, pages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Where the indexes of a folder were stored, by kind, application, folder and its files.
_STORED: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf_dir: str, kind: str, tables: tuple[str, ...], store: Callable[[str], object]) -> str:
    """The path of an index, written by ``store`` in the shared folder once per application."""
    files = tuple(sorted(f for t in tables for f in table(spark, sf_dir, t).inputFiles()))
    key = (kind, spark.sparkContext.applicationId, sf_dir, files)
    if key not in _STORED:
        path = fresh(spark, kind)
        store(path)
        _STORED[key] = path
    return _STORED[key]


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The lexical index of all nodes."""
    return open_index(spark, _stored(spark, sf_dir, "index", ("documents", "pages", "nation", "region"), lambda path: store_index(nodes(spark, sf_dir), path)))


def adjacency(spark: SparkSession, sf_dir: str) -> Adjacency:
    """The stored neighbours of all nodes."""

    def store(path: str) -> None:
        every = written(nodes(spark, sf_dir), "nodes")
        store_adjacency(derive_edges(every), every, path)

    return open_adjacency(spark, _stored(spark, sf_dir, "adjacency", ("documents", "pages", "nation", "region"), store))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored blocks of all vectors."""
    return open_vectors(spark, _stored(spark, sf_dir, "vectors", ("embeddings", "documents"), lambda path: store_vectors(vectors(spark, sf_dir), path)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of nodes that exist."""
    e, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    known = e.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return known.select(_key("doc", F.col("vec_id")).alias("id"), "embedding")


def cited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` of documents that cite another one, and sometimes an unknown one."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    cite = lambda c: F.concat(F.lit(" ["), c, F.lit("]"))
    unknown = F.when(F.col("doc_id") % 11 == 0, cite(_key("none", F.col("doc_id")))).otherwise("")
    return docs.select("doc_id", F.concat("text", cite(_key("doc", (F.col("doc_id") * 7) % n)), unknown).alias("text"))


#: The same projection for DuckDB.
SQL = r"""
uu AS (SELECT count(*) AS n FROM documents),
projects AS (SELECT regexp_replace(md5('region:' || r_regionkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS id, 'project' AS type, r_name AS title, '' AS body_md, 'canonical' AS kind, CAST(NULL AS VARCHAR) AS project_id, CAST(NULL AS VARCHAR) AS collection_id, CAST(NULL AS VARCHAR) AS pi_id, CAST(NULL AS VARCHAR[]) AS reference_ids, CAST(NULL AS VARCHAR) AS summary, TIMESTAMP '2023-12-31' AS updated_at FROM region),
collections AS (SELECT regexp_replace(md5('nation:' || n_nationkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS id, 'collection' AS type, n_name AS title, '' AS body_md, 'canonical' AS kind, regexp_replace(md5('region:' || n_regionkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS project_id, CAST(NULL AS VARCHAR) AS collection_id, CAST(NULL AS VARCHAR) AS pi_id, CAST(NULL AS VARCHAR[]) AS reference_ids, CAST(NULL AS VARCHAR) AS summary, TIMESTAMP '2023-12-31' AS updated_at FROM nation),
assets AS (SELECT regexp_replace(md5('doc:' || doc_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS id, (['note','docx','slides','pdf','spreadsheet','email','image','code'])[CAST(doc_id % 8 AS INT) + 1] AS type, source || '-' || doc_id AS title, text AS body_md, CASE WHEN doc_id % 4 = 0 THEN 'draft' ELSE 'canonical' END AS kind,
  regexp_replace(md5('region:' || n_regionkey), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS project_id,
  CASE WHEN doc_id % 5 <> 0 THEN regexp_replace(md5('nation:' || (doc_id % 25)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') END AS collection_id,
  CASE WHEN doc_id % 3 <> 0 THEN regexp_replace(md5('pi:' || (doc_id % 7)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') END AS pi_id,
  CASE WHEN doc_id % 10 = 0 THEN [regexp_replace(md5('doc:' || ((doc_id + 1) % n)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5'), regexp_replace(md5('doc:' || ((doc_id + 2) % n)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')] END AS reference_ids,
  CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 80) END AS summary, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS updated_at FROM documents JOIN nation ON doc_id % 25 = n_nationkey, uu),
page_nodes AS (SELECT regexp_replace(md5('page:' || page_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS id, 'url' AS type, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS body_md, 'canonical' AS kind, regexp_replace(md5('region:' || (page_id % 5)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS project_id, CAST(NULL AS VARCHAR) AS collection_id, CAST(NULL AS VARCHAR) AS pi_id, CAST(NULL AS VARCHAR[]) AS reference_ids, CAST(NULL AS VARCHAR) AS summary, TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 SECOND AS updated_at FROM pages),
nodes AS (SELECT * FROM projects UNION ALL SELECT * FROM collections UNION ALL SELECT * FROM assets UNION ALL SELECT * FROM page_nodes),
edges AS (
  SELECT id AS src_id, 'belongs-to-pi' AS predicate, pi_id AS dst_id FROM nodes WHERE pi_id <> ''
  UNION SELECT id, 'contains', project_id FROM nodes WHERE project_id <> '' AND project_id <> id
  UNION SELECT id, 'contains', collection_id FROM nodes WHERE collection_id <> '' AND collection_id <> id
  UNION SELECT ref, 'style-guides', id FROM (SELECT id, unnest(reference_ids) AS ref FROM nodes) WHERE ref <> ''),
cited AS (SELECT doc_id, text || ' [' || regexp_replace(md5('doc:' || ((doc_id * 7) % n)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || ']' || CASE WHEN doc_id % 11 = 0 THEN ' [' || regexp_replace(md5('none:' || doc_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || ']' ELSE '' END AS text FROM documents, uu)
"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, body)``: block JSON of each document, with a nested heading, an image and text after it."""
    d = F.col("doc_id")
    kind = "struct<id:string,type:string,props:struct<id:string,level:int,url:string,caption:string>,content:string>"
    block = lambda i, t, level, url, caption, text, stamp=None: F.struct(F.lit(i).alias("id"), F.lit(t).alias("type"), F.struct(F.lit(stamp).cast("string").alias("id"), level.cast("int").alias("level"), url.cast("string").alias("url"), caption.cast("string").alias("caption")).alias("props"), text.cast("string").alias("content")).cast(kind)
    none = F.lit(None)
    image = block("i1", "image", none, F.when(d % 3 == 0, F.concat(F.lit("data:application/octet-stream;base64,iVBOR"), F.md5("text"))).otherwise("http://x/y.png"), F.col("source"), none)
    inner = F.array(block("h2", "heading", d % 5 + 1, none, none, F.concat(F.lit("Part of "), "source")))
    heading = block("h1", "heading", F.lit(1), none, none, F.when(d % 7 == 0, "Contents").otherwise(F.col("lang")), "art-h1")
    parts = F.array(
        F.struct(heading["id"].alias("id"), heading["type"].alias("type"), heading["props"].alias("props"), heading["content"].alias("content"), inner.alias("children")),
        *(F.struct(b["id"].alias("id"), b["type"].alias("type"), b["props"].alias("props"), b["content"].alias("content"), F.lit(None).cast(f"array<{kind}>").alias("children")) for b in (image, block("p1", "paragraph", none, none, none, F.col("text")), block("p2", "paragraph", none, none, none, F.col("source")), block("l1", "bulletListItem", none, none, none, F.col("lang")))),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(parts.alias("blocks"))).alias("body"))
