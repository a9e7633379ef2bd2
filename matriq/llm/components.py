"""Connected components by alternating large-star and small-star, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matriq.llm.common import attach, discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node that links reach.

    Each round is two aggregations and two joins on node; the smallest neighbour of a node is a
    pre-aggregated minimum, never a collected list, and attach() spreads the edges of hubs. Rounds grow with the
    logarithm of the longest chain; the table of each is written to the shared folder, so a lost executor costs no
    earlier round, and deleted when the next is there.
    Edges with a null end and loops link nothing (a loop's node is its own component). No edges: no rows.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = materialize(e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("c")))
        large = attach(both, low, "u", ["m"], "v", "c").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")))
        to_low = attach(large, least, "u", ["m"], "v", "c").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(to_low.union(least.select("u", F.col("m").alias("v"))).select("u", "v").distinct())
        discard(links, low, large, least)
        links = after
        seen = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
