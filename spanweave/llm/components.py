"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_merge, spool, unspool


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round lowers a node's label and its label's label to the smallest
    label next door, then replaces labels by their own labels; rounds grow with
    the logarithm of the longest path.  Each round is a table in the shared
    folder.  In every join one side has a key once, so a node with very many
    edges can be split; minima are combined before the exchange.  All tables
    grow with the input, so none is sent to the driver.
    """
    both = spool(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = spool(
        both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")),
        "labels",
    )
    while True:
        seen = (
            both.join(by_merge(labels.select(F.col("node").alias("b"), "root")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("low"))
        )
        hooks = labels.join(by_merge(seen), "node")
        lowered = (
            hooks.select("node", F.least("root", "low").alias("root"))
            .union(hooks.where(F.col("low") < F.col("root")).select(F.col("root").alias("node"), F.col("low").alias("root")))
            .groupBy("node")
            .agg(F.min("root").alias("root"))
        )
        lowered = spool(lowered, "lowered")
        jump = lowered.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = lowered.join(by_merge(jump), "root").select("node", F.col("top").alias("root"))
        after = spool(after, "labels")
        changed = after.join(by_merge(labels.withColumnRenamed("root", "was")), "node").where("root <> was").limit(1).count()
        unspool(lowered)
        unspool(labels)
        labels = after
        if not changed:
            unspool(both)
            return labels
