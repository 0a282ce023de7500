"""Connected components of any graph by joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_table(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a cut of the lineage that outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). Labels pass to neighbours and
    then jump to the label of the label, so rounds grow with the logarithm of a component's width.
    All joins are by shuffles: labels that look small enough to broadcast would pass through the driver in every round."""
    both = shared_table(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = shared_table(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near.hint("merge"), "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        after = shared_table(lower.join(jump.hint("merge"), "low", "left").select("node", "old", F.least("low", F.coalesce("next", "low")).alias("component")))
        labels = after.select("node", "component")
        if not after.where("old <> component").limit(1).count():
            return labels
