"""Connected components of an undirected graph in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonora.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) long edges to (node, root): the smallest node reachable, for every node with an edge.

    Labels fall to the smallest label among a node and its neighbours, then to their label's label, so
    a path of n nodes takes about log n rounds. Each round is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        lower = written(lower)
        above = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = lower.join(above, "root").select("node", "was", F.least("root", "above").alias("root"))
        jumped = written(jumped)
        labels = jumped.select("node", "root")
        if jumped.filter("root <> was").isEmpty():
            return labels
