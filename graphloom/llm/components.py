"""Connected components of a table of links, by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, label)`` of every id that has a link; the label is the smallest id of its component.

    Every round takes the smallest label around each id, then the label of that label.
    Labels are written in the shared folder each round; only the number of changed labels
    reaches the driver.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = written(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("label").alias("m"))
        near = labels.join(around, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        step = written(near.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = step.select("id", "label")
        if not step.where("label <> old").limit(1).count():
            return labels
