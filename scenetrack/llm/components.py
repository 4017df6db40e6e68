"""Connected components of an edge table by repeated joins; labels are the least vertex of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex of an edge.

    Large-star and small-star steps in turn: each vertex's neighbours are hung on the least one around it, until the
    edges are stars, which a step leaves as they are. Rows never multiply: each step makes at most one edge per edge. Lineage is cut in every round.
    """
    links = cut_lineage(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    state = lambda: links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = None
    while (now := state()) != before:
        before = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut_lineage(both.where("v > u").join(least, "u").select("v", "m").where("v <> m").distinct())
        low = large.groupBy("v").agg(F.min("m").alias("w"))
        small = large.join(low, "v").select(F.when(F.col("m") == F.col("w"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("w").alias("u")).where("u <> v").distinct()
        links = cut_lineage(small.select("u", "v"))
    roots = links.select("u").distinct()
    return links.select(F.col("v").alias("vertex"), F.col("u").alias("component")).union(roots.select("u", "u"))
