"""Connected components of an edge table, by passing on the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its smallest node) of edges (a, b), both long.

    Each round takes the least label among the neighbours and then that node's
    own label (pointer jumping), so chains shorten fast: rounds grow with the
    logarithm of the longest path, and end when no label changes. Rounds are written
    to the shared folder; only the count of changed labels comes to the driver.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("comp").alias("c"))
        near = both.join(other, "b").groupBy("a").agg(F.min("c").alias("near"))
        now = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        now = written(now.join(jump, "next", "left").select("node", "comp", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        changed = now.where(F.col("comp") != F.col("next")).count()
        labels = now.select("node", F.col("next").alias("comp"))
        if not changed:
            return labels
