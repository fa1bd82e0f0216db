"""Structured Streaming jobs: the incremental index, in-flight de-duplication, audit counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.search import embed
from graphloom.operators.upserts import coalesce_saves
from graphloom.session import reach_workers
from graphloom.sources.records import RECORD, node_rows
from graphloom.streaming.generations import update_tables


def audit_counts(audit: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(window_start, kind, n)`` over tumbling windows; batch or stream."""
    if audit.isStreaming:
        audit = audit.withWatermark("ts", late)
    return audit.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def dedupe_tasks(tasks: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Tasks whose key is not pending: a key passes again once the watermark has moved on by ``within``."""
    return tasks.withWatermark("ts", within).dropDuplicatesWithinWatermark(["key"])


def run_incremental(spark: SparkSession, source: str, target: str, checkpoint: str, embedder: Callable[[DataFrame], DataFrame] = embed) -> StreamingQuery:
    """Index new record files below ``source``: nodes, edges, vectors and postings below ``target`` follow, each batch once.

    A batch adds a generation, which is listed with the batch's number; see :mod:`graphloom.streaming.generations`.
    One stream writes to a target. Read the tables with :func:`~graphloom.streaming.generations.open_tables`.
    """
    reach_workers(spark)
    stream = spark.readStream.schema(RECORD).option("multiLine", True).json(source)
    rows = node_rows(stream.select("*", F.col("_metadata.file_path").alias("source_path")), "canonical")

    def apply(batch: DataFrame, batch_id: int) -> None:
        update_tables(coalesce_saves(batch, "id", ["updated_at_utc"]), target, embedder, batch_id)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
