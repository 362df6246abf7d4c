"""Connected components by the smallest label, with pointer jumping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from framewright.llm.common import cut


def components(links: list[DataFrame]) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the smallest node it can reach.

    Each round takes the smallest label of a node's neighbours and then that label's own label, so the rounds grow with the
    logarithm of the longest chain. Only (node, label) rows are shuffled, aggregated before they are.
    """
    edges = reduce(DataFrame.unionByName, links)
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct()
    both = cut(both, "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    before = None
    while (now := labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]) != before:
        before = now
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        nearer = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        labels = cut(nearer.join(jump, F.col("label") == F.col("_n"), "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label")), "labels")
    return labels


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label) of components() after further links: these are taken between the components that they connect, so
    that only those meet again. Without such links labels stay as they are."""
    if labels is None:
        return components([links])
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    ends = cut(ends.where("a != b").distinct(), "ends")
    if ends.isEmpty():
        return labels
    top = components([ends])
    known = labels.unionByName(top.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    return cut(known.join(top.toDF("label", "_top"), "label", "left").select("node", F.coalesce("_top", "label").alias("label")), "labels")
