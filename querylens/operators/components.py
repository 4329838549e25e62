"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_table, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges between longs -> (node, component), component the smallest node.

    Nodes without an edge to another node have no row. Each round hangs every
    node on the smallest one it knows; a hub's edges are pre-aggregated to one
    minimum before they meet, and the join back to the edges is one that the
    engine may split. Rounds grow with the logarithm of the longest chain. Null
    ends, loops and repeated edges are ignored; an empty table gives an empty one.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = e.where(edges["a"].isNotNull() & edges["b"].isNotNull()).where("u <> v").distinct()
    e = materialize(e, "edges")
    was = None
    while True:
        sign = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        was = sign
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written before they meet the edges, so that both sides of the join are plain exchanges, which the engine may split at a hub
        smallest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_table(smallest)
        drop_table(e)
        e = new
