"""Connected components of pairs, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.scale import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller, with the node) neighbours to the least of them all."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    met = both.join(least, F.col("a") == F.col("_a"))
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array("b", "_a")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node reachable, for each node of the pairs ``a``, ``b``.

    Each round is written to the shared folder, and its inputs are counted and hashed; the rounds end when a round
    leaves the pairs as they were. A node never meets all its neighbours in one row: minima are joined back to pairs.
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        now = cut(_star(_star(now, True), False), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
