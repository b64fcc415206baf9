"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest of them (or at the node itself).

    ``large``: the larger neighbours; else: the smaller ones and the node. The minimum is taken before the shuffle and
    joined back, so a node with very many neighbours is never gathered.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # In ``edges`` a > b: a node's smaller neighbours are the rows where it is a.
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``a, b`` (longs, both ways or one, repeated or not, loops ignored) -> ``node, label``: the smallest node of each
    component, for every node that has a link. Each round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path."""
    start = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = written(start, "edges")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(edges)
    while seen[0]:
        edges = written(_star(_star(edges, large=True), large=False), "edges")
        now = state(edges)
        if now == seen:
            break
        seen = now
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
