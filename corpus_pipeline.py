"""The corpus pipeline: quality rules, near duplicates, repeated substrings, packing.

Each stage reads what its predecessor kept, applies its decision and writes its result;
all but the last return the columns of ``documents``. Stages work on whole texts with any
further columns, which pass through.

Defined results: null and empty texts are rejected by the first stage; a document whose
text the third stage removes entirely stays, with an empty text, and packs as one end id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe, packing, probminhash, quality, suffix_dedup
from graphloom.llm.shared import only, unused, written
from graphloom.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    An id names one document: of rows with one id, the one with the smallest hash of its text
    is that document, and the others go before groups are formed.
    """
    rows, none = docs.where("doc_id is not null"), docs.where("doc_id is null")
    # only texts of ids that occur again are sorted
    again = written(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.isEmpty():
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", F.to_json(F.struct(*docs.columns)))
        hashes, n = again.select(F.xxhash64("doc_id")), unused(docs, "n")
        chosen = only(rows, F.xxhash64("doc_id"), hashes, "again").withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)
        rows = written(only(rows, F.xxhash64("doc_id"), hashes, "again", but=True).unionByName(chosen), "of-one-id")
    classes = probminhash.near_duplicates(rows.unionByName(none))
    kept = classes.where("doc_id = class_id or doc_id is null").select("doc_id").distinct()
    # whole texts stay where they are: ids are looked up in mapped files, not joined
    ids = written(kept.where("doc_id is not null"), "kept").select(F.xxhash64("doc_id"))
    return only(rows, F.xxhash64("doc_id"), ids, "kept").unionByName(none).select(*docs.columns)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that documents before them hold."""
    rest = suffix_dedup.without_repeats(docs, suffix_dedup.find_repeats(docs, least=50))
    return rest.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rest


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens."""
    return packing.best_two_fit(docs, bpe.vocabulary_path(), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup),
    ("repeated-substring removal", repeat_dedup),
    ("packing", pack),
]

#: SQL cannot express signatures, suffix order or packing; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
