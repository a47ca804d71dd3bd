"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_shuffles

#: Nodes with more than this share of all edges, at most twice its inverse, are known to all tasks; none with fewer edges than LEAST is.
HUB_SHARE, LEAST = 1 / 500, 1000


def with_least(edges: DataFrame, least: DataFrame, on: str, hub: float) -> DataFrame:
    """edges joined with (_n, least, _degree) on a node. Edges of nodes with a degree over hub stay where they are."""
    hubs = least.filter(F.col("_degree") > hub)  # at most 2 / HUB_SHARE rows, as degrees sum to twice the edges
    of_hubs = edges.join(F.broadcast(hubs), F.col(on) == F.col("_n"))
    others = edges.join(F.broadcast(hubs.select("_n")), F.col(on) == F.col("_n"), "left_anti").join(least.filter(F.col("_degree") <= hub), F.col(on) == F.col("_n"))
    return of_hubs.unionByName(others).drop("_degree")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in edges (a long, b long); a component is named by its smallest node.

    Each round joins every edge to the smaller ends of a node, found by an aggregate that combines before it shuffles; the few
    nodes with very many edges are sent to the edges instead. Null ends and loops are ignored. Rounds grow with the logarithm
    of the longest chain.
    """
    e = edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e = checkpoint(e)
    seen, count, degree = None, e.count(), F.count(F.lit(1)).alias("_degree")
    while True:
        hub = max(LEAST, count * HUB_SHARE)
        # large star: of a node's larger neighbours, each is tied to the least of its neighbourhood
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(e.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = checkpoint(both.groupBy("n").agg(F.min("m").alias("least"), degree).select(F.col("n").alias("_n"), F.least("n", "least").alias("least"), "_degree"))
        large = checkpoint(with_least(both.filter("m > n"), least, "n", hub).select(F.col("least").alias("lo"), F.col("m").alias("hi")).distinct())
        # small star: a node and its smaller neighbours are tied to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("least"), degree).select(F.col("hi").alias("_n"), "least", "_degree")
        tied = with_least(large, low, "hi", hub)
        small = tied.select(F.col("least").alias("lo"), F.col("lo").alias("hi")).filter("lo <> hi").unionByName(low.select(F.col("least").alias("lo"), F.col("_n").alias("hi")))
        e = checkpoint(small.distinct())
        count, mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if (count, mark) == seen:
            break
        seen = (count, mark)
        free_shuffles(e.sparkSession)
    members = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.unionByName(roots)
