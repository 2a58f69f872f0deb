"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import stored


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for edges (a, b), by minimum labels with pointer jumping.
    Each round's labels are stored, so lineage stays short; hot nodes are split by AQE's skew joins."""
    both = stored(spark, edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(spark, both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "seen").alias("lower"))
        # A label is a node too: take that node's label.
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("far"))
        new = stored(spark, lower.join(jump, "lower", "left").select("node", F.col("label").alias("old"), F.least("lower", F.coalesce("far", "lower")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
