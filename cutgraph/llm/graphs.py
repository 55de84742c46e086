"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round takes the least label among a node and its neighbours, then that label's own label, so that
    labels travel exponentially far along chains that earlier rounds have shortened; rounds end when no label changed. Nothing but
    that count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.save(both)
    labels = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("node"), "l", F.lit(True).alias("changed")))
    while not labels.filter("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), F.col("l").alias("m")), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
        least = labels.select("node", F.col("l").alias("old")).join(near, "node").select("node", "old", F.least("old", "m").alias("m"))
        jumped = least.join(labels.select(F.col("node").alias("m"), F.col("l").alias("far")), "m", "left")
        new = jumped.select("node", F.least("m", "far").alias("l"), (F.least("m", "far") < F.col("old")).alias("changed"))
        new, before = scratch.save(new), labels
        labels = new
        scratch.drop(before)
    scratch.drop(both)
    return labels.select("node", F.col("l").alias("component"))
