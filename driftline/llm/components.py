"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node, for every node of ``edges`` (``a``, ``b``).

    Every round each node takes the smallest label around it, then its label's label; the rounds grow
    with the logarithm of a component's width. Labels are written after each round.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "cc-labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        told = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("component", "least").alias("next"), "component")
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        told = told.join(jump, F.col("next") == F.col("to")).select("node", F.least("next", "further").alias("next"), "component")
        told = materialize(told, "cc-labels")
        labels = told.select("node", F.col("next").alias("component"))
        if told.where("next <> component").isEmpty():
            return labels
