"""Connected components of a distributed edge list (alternating star contractions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import stored

MAX_ROUNDS = 60


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node among ``u`` and its neighbours ``v`` in rows (u, v)."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for every node in rows (u, v).

    Each round links the larger neighbours of every node to its smallest one, then
    its smaller neighbours likewise; stars remain after O(log n) rounds in practice.
    Only minima are aggregated, no neighbour list is ever gathered, and each round
    ends in the shared folder.
    """
    now = stored(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star0"
    )
    seen = None
    for k in range(MAX_ROUNDS):
        # large star, both directions: v > u goes to m(u)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_min_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star, u > v only: the smaller neighbours and u itself go to m(u)
        small = large.join(_min_neighbour(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u != v").distinct(), f"star{k + 1}")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(mark)
    raise RuntimeError("components did not settle")
