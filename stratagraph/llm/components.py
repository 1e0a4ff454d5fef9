"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.runtime import cut, cut_few


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of the edges (a, b).

    Each round takes the least label among the neighbours and then the label's own label, which
    halves long chains. Labels meet edges by shuffled joins, whose hot keys Spark splits, and
    minima are combined before they are shuffled.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    n = both.count()
    labels = cut_few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), n)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("now"))
        over = labels.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        jumped = new.join(over, F.col("now") == F.col("__n"), "left").select("node", "old", F.least(F.col("now"), F.coalesce("__c", "now")).alias("component"))
        jumped = cut_few(jumped, n)
        labels = jumped.select("node", "component")
        if jumped.filter(F.col("old") != F.col("component")).isEmpty():
            return labels
