"""Edges: derivation from metadata, maintenance, integrity and expansion.

An edge is ``(src_id, predicate, dst_id)`` and occurs once. All maintenance is anti-joins
and unions of whole tables, so that running it twice changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import fresh, written

KEY = ["src_id", "predicate", "dst_id"]


def derive_edges(nodes: DataFrame) -> DataFrame:
    """All edges that the nodes' metadata states: scope, containment, style guides.

    Nodes whose metadata has been promoted to columns are read from these, others from ``jsonld``.
    """
    promoted = {"piId": "pi_id", "projectId": "project_id", "collectionId": "collection_id", "referenceIds": "reference_ids"}
    ready = set(promoted.values()) <= set(nodes.columns)
    meta = lambda k: F.col(promoted[k]) if ready else F.get_json_object("jsonld", f"$.{k}")
    edge = lambda s, p, d: F.struct(s.alias("src_id"), F.lit(p).alias("predicate"), d.alias("dst_id"))
    own = F.col("id")
    refs = meta("referenceIds") if ready else F.from_json(meta("referenceIds"), "array<string>")
    guides = F.coalesce(F.transform(refs, lambda r: edge(r, "style-guides", own)), F.array().cast("array<struct<src_id:string,predicate:string,dst_id:string>>"))
    single = F.array(edge(own, "belongs-to-pi", meta("piId")), edge(own, "contains", meta("projectId")), edge(own, "contains", meta("collectionId")))
    rows = nodes.select("id", F.explode(F.concat(single, guides)).alias("e")).select("e.*")
    rows = rows.where("src_id <> '' and dst_id <> '' and not (predicate = 'contains' and src_id = dst_id)")
    return rows.dropDuplicates(KEY)


def replace_edges(edges: DataFrame, new: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Edges after those of every (source, predicate) in ``keys`` (or ``new``) gave way to ``new``."""
    owners = (new if keys is None else keys).select("src_id", "predicate").distinct()
    return edges.join(owners, ["src_id", "predicate"], "left_anti").select(*KEY).unionByName(new.select(*KEY).dropDuplicates(KEY))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*KEY), KEY, "left_anti")


def delete_edges_by_src(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_anti").select(*KEY)


def delete_nodes(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, their out-edges and vectors gone; edges that lead to them stay and dangle."""
    gone = ids.select("id")
    return nodes.join(gone, "id", "left_anti"), delete_edges_by_src(edges, gone), vectors.join(gone, "id", "left_anti")


def remove_cascade(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes gone with their edges in both directions."""
    gone = ids.select("id")
    left = edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*KEY)


def edges_of(edges: DataFrame, node_id: str, predicate: str, direction: str = "out") -> DataFrame:
    """Out- or in-edges of one node for a predicate."""
    at = "src_id" if direction == "out" else "dst_id"
    return edges.where((F.col(at) == node_id) & (F.col("predicate") == predicate)).select(*KEY)


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an issue: a missing source or target, or a predicate ``self`` between two nodes."""
    ids = nodes.select("id")
    no_src = edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_anti").withColumn("issue", F.lit("missing-source"))
    no_dst = edges.join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti").withColumn("issue", F.lit("missing-target"))
    odd = edges.where("predicate = 'self' and src_id <> dst_id").withColumn("issue", F.lit("self-between-two"))
    return no_src.select(*KEY, "issue").unionByName(no_dst.select(*KEY, "issue")).unionByName(odd.select(*KEY, "issue"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``(id, other, predicate)``: each edge from both of its ends; two equi-joins instead of an or-join."""
    out = edges.select(F.col("src_id").alias("id"), F.col("dst_id").alias("other"), "predicate")
    return out.unionByName(edges.select(F.col("dst_id").alias("id"), F.col("src_id").alias("other"), "predicate"))


#: Seeds keep at most so many neighbours, and of a node on the way at most twice as many count.
MOST = 50


@dataclass(frozen=True)
class Adjacency:
    """What expansion reads: ``near`` (id, n, other, predicate), the first ``2 * MOST + 1`` existing neighbours of each id by
    (smallest predicate, neighbour); ``lost`` (id, other), neighbours that are no nodes; ``cards`` (id, type, title, snippet)."""

    near: DataFrame
    lost: DataFrame
    cards: DataFrame


def store_adjacency(edges: DataFrame, nodes: DataFrame, path: str) -> Adjacency:
    """Write the adjacency of a graph below ``path``, sorted by id, and open it.

    The limit is applied within tasks before rows are exchanged, so a hub sends its first rows
    from each task and not all of its neighbours, and has no more rows than other nodes after that.
    """
    spark = edges.sparkSession
    pairs = both_ways(edges).groupBy("id", "other").agg(F.min("predicate").alias("predicate"))
    known = nodes.select(F.col("id").alias("other"), F.lit(True).alias("known"))
    pairs = written(pairs.join(known, "other", "left"), "pairs")
    best = Window.partitionBy("id").orderBy("predicate", "other")
    near = pairs.where("known").withColumn("n", F.row_number().over(best)).where(F.col("n") <= 2 * MOST + 1).select("id", "n", "other", "predicate")
    cards = nodes.select("id", "type", "title", F.substring("body_md", 1, 200).alias("snippet"))
    for name, rows, by in (("near", near, ["id", "n"]), ("lost", pairs.where("known is null").select("id", "other"), ["id", "other"]), ("cards", cards, ["id"])):
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/{name}")
    return open_adjacency(spark, path)


def open_adjacency(spark: SparkSession, path: str) -> Adjacency:
    """The adjacency of :func:`store_adjacency`."""
    return Adjacency(*(spark.read.parquet(f"{path}/{name}") for name in ("near", "lost", "cards")))


def expand(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """As :func:`expand_stored`, of a graph without a stored adjacency."""
    return expand_stored(store_adjacency(edges, nodes, fresh(edges.sparkSession, "adjacency")), seeds, depth, limit)


def expand_stored(graph: Adjacency, seeds: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """``(seed, id, hop, predicate, type, title, snippet)``: neighbours of each seed up to two hops.

    A node counts for the hop at which it is first met, with the smallest predicate that
    leads to it; each seed keeps ``limit`` by (hop, predicate, id) among nodes that exist.

    Only seeds whose first hop leaves room take a second one, and then each node on the way
    offers its first ``2 * limit`` neighbours: at most ``limit`` of these are the seed or known
    from the first hop, and at most ``limit`` come before the last one kept. So the second hop
    has at most ``2 * limit`` rows per edge of a seed, however large a hub on the way is.
    """
    depth, limit = max(1, min(2, depth)), max(1, min(MOST, limit))
    seeds = written(seeds.select("seed").where("seed is not null").distinct(), "seeds")
    best = Window.partitionBy("seed").orderBy("predicate", "id")
    one = graph.near.where(F.col("n") <= limit + 1).select(F.col("id").alias("seed"), F.col("other").alias("id"), "predicate").where("seed <> id").join(seeds, "seed", "left_semi")
    first = one.withColumn("n", F.row_number().over(best)).where(F.col("n") <= limit).select("seed", "id", F.lit(1).alias("hop"), "predicate")
    found = first = written(first, "first-hop")
    if depth == 2:
        full = first.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("seed")
        short = written(seeds.join(full, "seed", "left_anti"), "short")
        # all neighbours of a short seed: those of its first hop, and what is no node itself
        way = first.join(short, "seed", "left_semi").select("seed", "id").unionByName(graph.lost.select(F.col("id").alias("seed"), F.col("other").alias("id")).join(short, "seed", "left_semi").where("seed <> id"))
        two = way.join(graph.near.where(F.col("n") <= 2 * limit), "id").where("other <> seed").groupBy("seed", F.col("other").alias("id")).agg(F.min("predicate").alias("predicate"))
        two = two.join(first.select("seed", "id"), ["seed", "id"], "left_anti")
        found = first.unionByName(two.select("seed", "id", F.lit(2).alias("hop"), "predicate"))
    best = Window.partitionBy("seed").orderBy("hop", "predicate", "id")
    kept = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= limit).drop("n")
    return kept.join(graph.cards, "id").select("seed", "id", "hop", "predicate", "type", "title", "snippet")


def member_counts(edges: DataFrame) -> DataFrame:
    return edges.where("predicate = 'contains'").groupBy(F.col("dst_id").alias("parent_id")).agg(F.count("*").alias("n"))
