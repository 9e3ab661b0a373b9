"""Connected components by contraction: each node points to its smallest neighbour below it, pointers are followed to their ends, edges move to the ends, until none is left. Joins and sums only, so a node with many edges is dealt like any other key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long. Returns node, component for every node of an edge; component is the smallest node reached."""
    spark = edges.sparkSession
    edges = first = staged(spark, _tidy(edges), "edges")
    levels = []
    while not edges.isEmpty():
        parent = staged(spark, edges.groupBy("hi").agg(F.min("lo").alias("p")), "parent")
        while True:
            up = parent.select(F.col("hi").alias("_hi"), F.col("p").alias("_p"))
            parent = staged(spark, parent.join(up, F.col("p") == F.col("_hi"), "left").select("hi", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")), "parent")
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        parent = parent.select(F.col("hi").alias("_node"), F.col("p").alias("_top"))
        levels.append(parent)
        ends = edges.join(parent, F.col("hi") == F.col("_node")).select("lo", F.col("_top").alias("b"))
        ends = ends.join(parent, F.col("lo") == F.col("_node"), "left").select(F.coalesce("_top", "lo").alias("a"), "b")
        edges = staged(spark, _tidy(ends), "edges")
    out = first.select(F.col("lo").alias("node")).union(first.select("hi")).distinct().withColumn("component", F.col("node"))
    for parent in levels:
        out = out.join(parent, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_top", "component").alias("component"))
    return staged(spark, out, "components")
