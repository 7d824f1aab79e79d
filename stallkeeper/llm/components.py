"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of the links ``a, b``: the label is the same within a component.

    Each round gives every node the smallest of itself and its neighbours, and links these instead; self-links and
    repeated links vanish, until none is left. Node ids should be hashes, so that a path shrinks by a constant factor a
    round. Smallest neighbours are found with map-side combination, and both sides of the joins are stored tables, so a
    node with very many links is split over tasks.
    """
    def unlike(rows):
        return cut_lineage(rows.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    edges, steps = unlike(links), []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            edges.select(F.col("b"), F.col("a")))
        step = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("label")))
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = unlike(edges.join(left, "a").join(right, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    result = steps[-1]
    for step in reversed(steps[:-1]):
        later = result.select(F.col("node").alias("label"), F.col("label").alias("last"))
        result = cut_lineage(step.join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label")))
    return result
