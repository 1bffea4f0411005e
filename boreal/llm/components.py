"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreal.llm.common import new_folder, remove


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component: the least node. Each round takes the least label around a node, then that label's own label; the labels are written to the shared folder each round."""
    spark = edges.sparkSession
    both = _written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), kept := new_folder(spark, "cc-edges"))
    labels = _written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), last := new_folder(spark, "cc"))
    while True:  # some log2 of the longest way rounds
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = nearer.join(up, "component", "left").select("node", "old", F.least("component", "above").alias("component"))
        now = _written(jumped, folder := new_folder(spark, "cc"))
        changed = now.filter("old <> component").limit(1).count()
        remove(spark, last)
        labels, last = now.select("node", "component"), folder
        if not changed:
            remove(spark, kept)
            return labels
