"""Connected components of a table of links, by large-star and small-star steps; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import cut


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large-star (both) links the larger neighbours of each node to its least neighbour; small-star the smaller ones and the node itself."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if both:
        e = edges.union(flipped)
    else:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = e.join(least, "a")
    if both:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node -> root (its component's least node), for every node that has a link. edges: columns a and b of one orderable type; links of a node with itself and repeated links may occur."""
    e = cut(edges.select("a", "b").where("a <> b").distinct())
    while True:
        n = _star(_star(e, True), False).where("a <> b")
        n = cut(n)
        if n.count() == e.count() and n.exceptAll(e).isEmpty():
            break
        e = n
    own = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own)
