"""Connected components of a graph of links, by alternating large-star and small-star rounds on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.storage import materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large star links each larger neighbour of a node to the smallest of the node and its neighbours,
    small star each smaller neighbour and the node itself. The minimum is a pre-aggregated column joined back from a
    table, so that adaptive execution can split the rows of a frequent node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        new = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = materialise(new.where("u > v").distinct(), "links")
    release(least)
    return out


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node is either linked to one smaller node or to larger ones only: no round would change that."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    per = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not per.where("ups > 1 or (ups = 1 and least = 0)").limit(1).count()


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """Rows (node, root) for each node that has a link; root is the smallest node of its component, itself included.
    Null ends and self-links are ignored; links may repeat and point either way."""
    ends = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    edges = materialise(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _all_stars(edges):
        wide = _star(edges, large=True)
        after = _star(wide, large=False)
        release(edges, wide)
        edges = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
