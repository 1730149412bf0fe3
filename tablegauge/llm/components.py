"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import store

STEPS = 3


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Each round maps every node to the end of a few steps along its smallest neighbours, and links between different
    ends become the links of the next round. The maps of all rounds, applied one after the other, give the component.
    Only counts reach the driver.
    """
    pairs = store(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).filter(
        "x <> y").distinct(), "links")
    labels = pairs.select(F.col("x").alias("node")).distinct().withColumn("component", F.col("node"))
    while not pairs.isEmpty():
        step = store(pairs.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("to")), "steps")
        ends = step
        for _ in range(STEPS):
            ends = ends.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select(
                "node", F.col("next").alias("to"))
        ends = store(ends, "ends")
        labels = labels.join(ends.select(F.col("node").alias("component"), "to"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component"))
        pairs = store(pairs.join(ends.select(F.col("node").alias("x"), F.col("to").alias("ex")), "x").join(
            ends.select(F.col("node").alias("y"), F.col("to").alias("ey")), "y").filter("ex <> ey").select(
            F.col("ex").alias("x"), F.col("ey").alias("y")).distinct(), "links")
    return store(labels, "labels")
