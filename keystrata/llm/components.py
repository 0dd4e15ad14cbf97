"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum (with map-side combine) and one join of the links with these minima;
lineage is cut after every round.  The links of a hub meet in one partition of that join
as a stream, not as a list; adaptive execution splits it where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of u point to the smallest vertex of u's neighbourhood; large: those to larger ones, else to smaller ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) links to (id, component): every linked vertex with the smallest vertex reachable from it."""
    edges = links.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    edges = scratch.table(edges, "links")
    seen = _sign(edges)
    while seen[0]:
        # Neither step makes more links than there are, but for one of each vertex.
        new = scratch.table(_star(_star(edges, True), False), "links", 2 * seen[0])
        scratch.drop(edges)
        edges, last, seen = new, seen, _sign(new)
        if seen == last:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
