"""Connected components of an undirected graph of 64-bit nodes, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.shared import settled


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, label for each node of edges (u, v): label is the least node of its component.

    A round takes the least label around each node, then the label of that label, so chains shorten by half; each cuts
    its lineage by a checkpoint in the shared folder. Minima are taken before rows are dealt, and adaptive execution splits
    the joins of nodes with very many edges. Raises if it does not settle, rather than return part of a result.
    """
    both = settled(edges.filter("u <> v").select("u", "v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settled(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = lower.select(F.col("node").alias("_n"), F.col("new").alias("_l"))
        least = F.least("new", F.coalesce("_l", "new"))
        after = settled(lower.join(jump, F.col("new") == F.col("_n"), "left").select("node", least.alias("label"), (least < F.col("old")).alias("moved")))
        labels = after.drop("moved")
        if after.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
