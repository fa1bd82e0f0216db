"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout.

    An installed package, or one shipped with ``--py-files``, needs none of this;
    the extra entry is then harmless.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, PACKAGE_ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder, read with Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Only where that is unset, as in tests on one machine, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    made = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    sc.setCheckpointDir(made)
    return made


def fresh(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/graphloom-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet in the shared folder and read it again.

    Later stages reread the files, so a lost executor costs no recomputation.
    """
    path = fresh(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
