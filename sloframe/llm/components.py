"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloframe.llm.store import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of those (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    moved = edges.join(least, F.col("u") == F.col("w")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node it reaches) of every node of an edge.

    ``edges`` has columns u and v; loops and repeated edges do no harm and edges with a
    null end are left out. Each round is a few shuffles of the edges, written to the
    shared folder; hubs are met by partial minima and by joins that Spark splits. The
    driver sees two sums per round, by which it tells that nothing changed.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = stored(_small_star(_large_star(edges)).distinct(), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
