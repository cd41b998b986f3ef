"""Connected components of a graph given as pairs of ids, without gathering any vertex's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id reachable.

    edges(a, b): two different ids.  Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges are stars around the smallest ids.  Every step takes minima with map-side partial aggregation and one join
    of two plain shuffles, which adaptive execution can split where a vertex is hot; rounds grow as the log of the
    number of vertices.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        """(u, m): the smallest neighbour v of u; written, so that the join reads two plain shuffles."""
        return scratch.cut(pairs.groupBy("u").agg(F.min("v").alias("m")), "lowest")

    now = scratch.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = _state(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = lowest(both)
        large = both.where("v > u").join(low, "u").select(F.least("u", "m").alias("a"), F.col("v").alias("b")).distinct()
        large = scratch.cut(large, "large")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low_2 = lowest(down)
        stars = low_2.select(F.col("m").alias("a"), F.col("u").alias("b"))
        small = down.join(low_2, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(stars).distinct()
        new = scratch.cut(small, "small")
        was, state = state, _state(new)
        scratch.drop(low, large, low_2, now)
        now = new
        if state == was:
            break
    centres = now.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(centres)
