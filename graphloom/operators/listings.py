"""Listings, point reads, lookups that keep misses, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.maps import BUCKET_NAMES, bucket_of
from graphloom.functions.text import stripped


def list_nodes(nodes: DataFrame, node_type: str | None = None, kind: str | None = None, pi_id: str | None = None) -> DataFrame:
    """Nodes by type, kind and scope; a scope excludes nodes without one. Newest first."""
    for column, value in (("type", node_type), ("kind", kind), ("pi_id", pi_id)):
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    return nodes.select("id", "type", "title", "kind", "pi_id", "updated_at").orderBy(F.desc("updated_at"), "id")


def unassigned(nodes: DataFrame) -> DataFrame:
    return nodes.where("pi_id is null").select("id", "type", "title")


def newest(nodes: DataFrame, limit: int) -> DataFrame:
    return nodes.select("id", "type", "updated_at").orderBy(F.desc("updated_at"), "id").limit(limit)


def read_node(drafts: DataFrame, canonical: DataFrame, node_id: str) -> DataFrame:
    """One node; its draft, if there is one, hides the canonical record."""
    both = drafts.withColumn("_rank", F.lit(0)).unionByName(canonical.withColumn("_rank", F.lit(1))).where(F.col("id") == node_id)
    return both.orderBy("_rank").limit(1).drop("_rank")


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``(pos, id, found, title, type)`` for every asked id, misses included."""
    own = nodes.select("id", "title", "type", F.lit(True).alias("found"))
    return ids.join(own, "id", "left").select("pos", "id", F.coalesce("found", F.lit(False)).alias("found"), "title", "type")


def missing_embeddings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes with something to embed and no vector."""
    text = F.trim(F.concat_ws(" ", "title", "body_md"))
    return nodes.where(text != "").join(vectors.select("id"), "id", "left_anti").select("id", "type")


def cache_split(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key has cached text, with it, and rows that have to be extracted."""
    good = cache.where(F.trim("text") != "").select("key", F.col("text").alias("cached")).dropDuplicates(["key"])
    return rows.join(good, "key"), rows.join(good, "key", "left_anti")


def project_members(edges: DataFrame, nodes: DataFrame, project_id: str, limit: int = 200) -> DataFrame:
    """Nodes that the project contains, by id."""
    inside = edges.where((F.col("predicate") == "contains") & (F.col("dst_id") == project_id)).select(F.col("src_id").alias("id"))
    rows = nodes.join(inside, "id").select("id", "type", "title", F.get_json_object("jsonld", "$.summary").alias("summary"))
    return rows.orderBy("id").limit(max(1, min(500, limit)))


def by_type(nodes: DataFrame, node_type: str = "note", project_id: str | None = None, limit: int = 100) -> DataFrame:
    """Newest nodes of a type, of one project if given; filters first, then the limit."""
    rows = nodes.where(F.col("type") == node_type)
    if project_id is not None:
        rows = rows.where(F.col("project_id") == project_id)
    return rows.select("id", "title", "updated_at").orderBy(F.desc("updated_at"), "id").limit(max(1, min(500, limit)))


def collection_assets(nodes: DataFrame, collection: str, project_id: str | None = None) -> DataFrame:
    """Assets of a stored collection, or of a bucket view named ``type-<bucket>``, in one project if given; collections are no assets."""
    rows = nodes.where(~F.col("type").isin("collection", "project"))
    if project_id is not None:
        rows = rows.where(F.col("project_id") == project_id)
    hit = bucket_of(F.col("type")) == collection.removeprefix("type-") if collection.startswith("type-") else F.col("collection_id") == collection
    return rows.where(hit).select("id", "type", "title")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, newest change. Two aggregates of one row each meet in one task."""
    parts = nodes.agg(F.count("*").alias("n_nodes"), F.lit(0).cast("long").alias("n_edges"), F.max("updated_at").alias("newest"))
    other = edges.agg(F.lit(0).cast("long").alias("n_nodes"), F.count("*").alias("n_edges"), F.lit(None).cast("timestamp_ntz").alias("newest"))
    return parts.unionByName(other).agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"), F.max("newest").alias("newest"))


def bucket_counts(nodes: DataFrame) -> DataFrame:
    """``(project_id, bucket, n)`` with zeros for all nine buckets of every project that has nodes."""
    counted = nodes.where("project_id is not null").withColumn("bucket", bucket_of(F.col("type"))).groupBy("project_id").pivot("bucket", BUCKET_NAMES).agg(F.count(F.lit(1)))
    pairs = F.array(*(F.struct(F.lit(b).alias("bucket"), F.coalesce(F.col(f"`{b}`"), F.lit(0)).cast("long").alias("n")) for b in BUCKET_NAMES))
    return counted.select("project_id", F.inline(pairs))


def collection_counts(nodes: DataFrame) -> DataFrame:
    """``(collection_id, n)`` for every known collection; unknown ones are ignored."""
    known = nodes.where("type = 'collection'").select(F.col("id").alias("collection_id"))
    counted = nodes.where("type <> 'collection'").groupBy("collection_id").agg(F.count("*").alias("n"))
    return known.join(counted, "collection_id", "left").select("collection_id", F.coalesce("n", F.lit(0)).alias("n"))


def concat_bodies(nodes: DataFrame, ids: DataFrame, cap: int = 24000, block: int = 512) -> DataFrame:
    """``(group_id, text)``: the bodies of each group's ids in order, under their titles, cut at ``cap`` characters.

    Only the parts that begin within the first ``cap`` characters are gathered. Where they
    begin follows from running sums over the lengths: of blocks of at most about ``block``
    parts by position, then of the parts within the blocks that begin early enough.
    """
    part = F.concat(F.lit("## "), F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("id")), F.lit("\n"), F.col("body_md"))
    rows = ids.join(nodes.select("id", "title", "body_md"), "id").select("group_id", "pos", part.alias("part"))
    # a missing body takes no room; any other part is followed by two line ends
    rows = rows.select("group_id", "pos", F.substring("part", 1, cap).alias("head"), F.coalesce(F.length("part") + 2, F.lit(0)).cast("long").alias("room"))
    blocks = _position_blocks(rows.select("group_id", "pos", "room"), block)
    total = blocks.groupBy("group_id").agg((F.sum("room") - 2).alias("total"))
    before = Window.partitionBy("group_id").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    early = blocks.withColumn("begin", F.coalesce(F.sum("room").over(before), F.lit(0))).where((F.col("begin") < cap) & (F.col("room") > 0))
    early = early.select(F.col("group_id").alias("of"), "low", "high", "begin")
    near = rows.where("room > 0").join(early, (F.col("group_id") == F.col("of")) & (F.col("pos") >= F.col("low")) & (F.col("pos") <= F.col("high")))
    within = Window.partitionBy("group_id", "low").orderBy("pos", "head").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("at", F.col("begin") + F.coalesce(F.sum("room").over(within), F.lit(0))).where(F.col("at") < cap)
    joined = near.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("at", "head"))).alias("parts"))
    text = F.substring(F.array_join(F.transform("parts", lambda p: p["head"]), "\n\n"), 1, cap)
    out = total.join(joined.select("group_id", text.alias("text")), "group_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    left = F.col("total") - cap
    return out.select("group_id", F.when(left > 0, F.concat("text", F.lit("\n[truncated — "), left.cast("string"), F.lit(" more chars]"))).otherwise(F.col("text")).alias("text"))


def _position_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``(group_id, low, high, room)``: each group's positions in stretches, with their rooms' sum.

    Rows are ranged by (group, position) over tasks, and a task cuts its sorted rows every
    ``block`` rows; equal positions of a group lie in one task and in one stretch.
    """
    at = F.monotonically_increasing_id()
    sorted_ = rows.groupBy("group_id", "pos").agg(F.sum("room").alias("room")).repartitionByRange("group_id", "pos").sortWithinPartitions("group_id", "pos")
    numbered = sorted_.withColumn("stretch", F.floor(at / block))
    return numbered.groupBy("group_id", "stretch", F.spark_partition_id().alias("task")).agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.sum("room").alias("room")).select("group_id", "low", "high", "room")


def active_project(nodes: DataFrame, saved: str | None) -> DataFrame:
    """The saved project if it still exists, else the one changed last."""
    is_saved = F.coalesce(F.col("id") == saved, F.lit(False)) if saved else F.lit(False)
    return nodes.where("type = 'project'").orderBy(F.desc(is_saved), F.desc("updated_at"), "id").limit(1).select("id", "title")


def markdown_mirror(nodes: DataFrame) -> DataFrame:
    """``(id, text)``: front matter, title line and text of each node; an undecided node has an empty decision."""
    title = F.replace("title", F.lit("\n"), F.lit(" "))
    decision = F.coalesce("policy_decision_id", F.lit("")) if "policy_decision_id" in nodes.columns else F.lit("")
    stamp = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.format_string("---\nid: %s\ntype: %s\ntitle: %s\nupdatedAtUtc: %s\npolicyDecisionId: %s\n---\n\n# %s\n\n", "id", "type", title, stamp, decision, title)
    return nodes.select("id", F.concat(head, stripped(F.coalesce("body_md", F.lit(""))), F.lit("\n")).alias("text"))
