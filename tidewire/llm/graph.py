"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.settings import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` for every node on a link; nodes are connected when their roots are equal.

    In each round every node joins its smallest neighbour, and the links are carried over to what they
    became; links inside one node go. With hash-like node numbers this ends after a number of rounds
    that grows with the logarithm of the longest path. Each round is written to the shared folder.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = materialize(both.distinct(), "links")
    nodes = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
    nodes = materialize(nodes.withColumnRenamed("u", "node"), "roots")
    lowest = nodes
    while True:
        to = lowest.select(F.col("node"), F.col("root").alias("to"))
        moved = links.join(to.withColumnRenamed("node", "u"), "u")
        moved = moved.select(F.col("to").alias("x"), "v").join(to.withColumnRenamed("node", "v"), "v")
        moved = moved.select(F.col("x").alias("u"), F.col("to").alias("v")).filter("u <> v")
        links = materialize(moved.distinct(), "links")
        if links.isEmpty():
            return nodes
        lowest = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
        lowest = materialize(lowest.withColumnRenamed("u", "node"), "roots")
        step = lowest.select(F.col("node").alias("root"), F.col("root").alias("next"))
        nodes = nodes.join(step, "root", "left")
        nodes = materialize(nodes.select("node", F.coalesce("next", "root").alias("root")), "roots")
