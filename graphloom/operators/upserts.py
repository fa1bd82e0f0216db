"""Keyed upserts as whole-table rewrites; each is the same when run twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import uuid_of
from graphloom.operators.bodies import merge_metadata
from graphloom.operators.graph import derive_edges, replace_edges
from graphloom.session import reach_workers


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", version: str = "updated_at") -> DataFrame:
    """Last write wins: the newest row of each key; of equal versions the update's."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    best = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_new")


def upsert_vectors(base: DataFrame, new: DataFrame, dims: int) -> DataFrame:
    """Vectors replaced by new ones; a null new vector keeps the old one, a wrong dimension is an error."""
    good = F.when(F.col("new").isNull() | (F.size("new") == dims), F.col("new")).otherwise(F.raise_error(F.lit(f"vectors need {dims} dimensions")).cast("array<float>"))
    both = base.select("id", F.col("embedding").alias("old")).join(new.select("id", F.col("embedding").alias("new")), "id", "full_outer")
    return both.select("id", F.coalesce(good, "old").alias("embedding")).where("embedding is not null")


def merge_edit(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited nodes take title, body and time of the edit and keep kind and all else."""
    e = edits.select("id", F.col("title").alias("_t"), F.col("body_md").alias("_b"), F.col("updated_at").alias("_u"))
    rows = base.join(e, "id", "left")
    for c, n in (("title", "_t"), ("body_md", "_b"), ("updated_at", "_u")):
        rows = rows.withColumn(c, F.coalesce(n, c))
    return rows.select(*base.columns)


@dataclass(frozen=True)
class Promotion:
    """All nodes afterwards, all edges afterwards, and an audit line ``kind, timestamp, body`` per promoted draft."""

    nodes: DataFrame
    edges: DataFrame
    audit: DataFrame


def promote(nodes: DataFrame, ids: DataFrame, at: str, edges: DataFrame | None = None, actor: str = "job") -> Promotion:
    """Drafts among ``ids`` become canonical, with a decision id and the run's time; all else of them stays.

    The edges of a promoted node are derived anew. Ids of no draft change nothing.
    """
    hit = nodes.join(ids.select("id", F.lit(True).alias("_hit")).dropDuplicates(["id"]), "id", "left")
    draft = F.col("_hit").isNotNull() & (F.col("kind") == "draft")
    decision = uuid_of(F.concat(F.lit("decision:"), "id"))
    kept = F.col("policy_decision_id") if "policy_decision_id" in nodes.columns else F.lit(None).cast("string")
    moved = hit.select(
        *(F.when(draft, "canonical").otherwise(F.col("kind")).alias("kind") if c == "kind" else F.when(draft, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at" else F.col(c) for c in nodes.columns if c != "policy_decision_id"),
        F.when(draft, decision).otherwise(kept).alias("policy_decision_id"),
    )
    chosen = hit.where(draft).select(*nodes.columns)
    body = F.to_json(F.struct(F.lit(actor).alias("actor"), decision.alias("decisionId"), F.col("id").alias("draftId"), F.col("type").alias("nodeType"), F.concat(F.lit("kb/"), "type", F.lit("s/"), "id", F.lit(".json")).alias("canonicalPath"), F.lit(at).alias("promotedAtUtc")))
    audit = chosen.select(F.lit("workspace.promoteDraft").alias("kind"), F.lit(at).alias("timestamp"), body.alias("body"))
    return Promotion(moved, refresh_edges(derive_edges(nodes) if edges is None else edges, chosen), audit)


def refresh_edges(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges after the changed nodes' own ones were derived anew: what they contain, their scope, and the guides that lead to them."""
    ids = changed.select("id")
    rest = edges.join(ids.withColumnRenamed("id", "src_id").withColumn("_own", F.lit(True)), "src_id", "left").join(ids.withColumnRenamed("id", "dst_id").withColumn("_guided", F.lit(True)), "dst_id", "left")
    own = F.coalesce("_own", F.lit(False)) & F.col("predicate").isin("contains", "belongs-to-pi")
    guided = F.coalesce("_guided", F.lit(False)) & (F.col("predicate") == "style-guides")
    return rest.where(~(own | guided)).select("src_id", "predicate", "dst_id").unionByName(derive_edges(changed)).distinct()


def reassign(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Assets moved to another collection, or out of any (null), in their column and in their metadata.

    Of several moves of one id the largest collection id counts. :func:`reassign_edges` makes the edges follow.
    """
    m = moves.groupBy("id").agg(F.max("collection_id").alias("_to"), F.lit(True).alias("_hit"))
    rows = nodes.join(m, "id", "left")
    moved = rows.withColumn("collection_id", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("collection_id")))
    if "jsonld" in nodes.columns:
        reach_workers(nodes.sparkSession)
        to = F.concat(F.lit('{"collectionId":'), F.coalesce(F.concat(F.lit('"'), "_to", F.lit('"')), F.lit("null")), F.lit("}"))
        moved = moved.withColumn("jsonld", merge_metadata(F.col("jsonld"), F.when(F.col("_hit"), to)))
    return moved.select(*nodes.columns)


def reassign_edges(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges after the moved nodes' ``contains`` edges gave way to those of their new collection."""
    keys = moved.select(F.col("id").alias("src_id"), F.lit("contains").alias("predicate"))
    return replace_edges(edges, derive_edges(moved).where("predicate = 'contains'"), keys)


def coalesce_saves(saves: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest payload of each key."""
    return saves.groupBy(key).agg(F.max_by(F.struct(*saves.columns), F.struct(*order)).alias("_s")).select("_s.*")


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti").select(*base.columns))
