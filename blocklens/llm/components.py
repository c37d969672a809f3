"""Connected components of a link table, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; root is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label
    of that label (pointer jumping), so the rounds grow with the logarithm of a
    component's diameter.  Every round is a table in the shared folder.
    """
    edges = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_n")).agg(F.min("root").alias("_m"))
        lower = labels.join(near, F.col("node") == F.col("_n")).select("node", F.col("root").alias("_old"), F.least("root", "_m").alias("_low"))
        ahead = labels.select(F.col("node").alias("_t"), F.col("root").alias("_far"))
        found = lower.join(ahead, F.col("_low") == F.col("_t"), "left").select("node", F.least("_low", "_far").alias("root"), "_old")
        found = scratch.save(found, f"{name}-{step}")
        moved = found.filter("root != _old").limit(1).count()
        labels = found.select("node", "root")
        scratch.drop(f"{name}-{step - 1}")
        if not moved:
            return labels
