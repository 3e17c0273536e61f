"""Connected components by Spark joins: contraction of neighbourhoods in an order that is drawn anew each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long, not null); component is the smallest node reachable.

    Each round merges a node into the one of its neighbours and itself with the smallest hash, and edges are led over to the merged nodes, until none
    is left. xxhash64 of one long is one to one, so the hash is the merged node's name, and hashing names anew draws a new order each round: the nodes
    with edges about halve on a path, whatever their numbers, and so the tables shrink to nothing. Should ``max_rounds`` be met with edges left, it raises.
    Then names are followed back, level by level. The driver gets one yes or no a round.
    """
    both = edges.select("a", "b").where("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    levels: list[DataFrame] = []
    while not both.isEmpty():
        if len(levels) == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.xxhash64("b")).alias("near"))
        ups = materialize(near.select("node", F.least("near", F.xxhash64("node")).alias("up")), "merged")
        met = both.join(ups.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(ups.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        new = materialize(met.where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(), "edges")
        discard(both)
        levels, both = [*levels, ups], new
    if not levels:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # A name belongs to its level: names of two levels may be equal by chance.
    found = levels[-1].select("node", F.col("up").alias("root"), F.lit(len(levels)).alias("level"))
    for i in range(len(levels) - 1, 0, -1):
        above = found.select(F.col("node").alias("up"), "root", "level")
        joined = levels[i - 1].join(above, "up", "left")
        new = materialize(joined.select("node", F.coalesce("root", "up").alias("root"), F.coalesce("level", F.lit(i)).alias("level")), "labels")
        discard(found)
        found = new
    least = found.groupBy("root", "level").agg(F.min("node").alias("component"))
    return found.join(least, ["root", "level"]).select("node", "component")
