"""Relational tree operators on the nodes table: closure, descendants, lowest common ancestors and roll-up.

The nodes table needs node_id (pre-order), subtree_end and, for ancestors, path (its ancestors and itself as structs of id and end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.operators import cuts

#: A table is broadcast up to this size, which the plan's statistics tell without a job; above, joins shuffle (and may still turn out small at run time).
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame) -> DataFrame:
    """Broadcast if the plan knows the table to be small, as it does of driver-made trees and of files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, dist), with each node its own ancestor: linear in nodes times depth, no range join."""
    up = nodes.select(F.col("node_id").alias("descendant"), F.size("path").alias("_n"), F.posexplode("path").alias("_i", "_a"))
    return up.select(F.col("_a.id").alias("ancestor"), "descendant", (F.col("_n") - 1 - F.col("_i")).alias("dist"))


def with_paths(nodes: DataFrame) -> DataFrame:
    """Adds path from node_id, parent and subtree_end, for trees of any depth."""
    item = F.struct(F.col("node_id").alias("id"), F.col("subtree_end").alias("end"))
    return nodes.join(cuts.chains(nodes, "node_id", "parent", item, "path"), "node_id").select(*nodes.columns, "path")


def lca_of_range(path: Column | str, high: Column | str) -> Column:
    """The lowest ancestor on ``path`` (of the least id) whose subtree holds the greatest id ``high``."""
    high = F.col(high) if isinstance(high, str) else high
    return F.array_max(F.transform(F.filter(path, lambda a: a["end"] >= high), lambda a: a["id"]))


def lca_pairs(pairs: DataFrame, nodes: DataFrame, low: str = "lo", high: str = "hi", out: str = "lca") -> DataFrame:
    """Adds the lowest common ancestor of the nodes ``low`` and ``high`` (low <= high)."""
    paths = nodes.select(F.col("node_id").alias(low), F.col("path").alias("_path"))
    return pairs.join(sized(paths), low, "left").withColumn(out, lca_of_range("_path", high)).drop("_path")


def roll_up(counts: DataFrame, nodes: DataFrame, keys: list[str], values: list[str], node: str = "node") -> DataFrame:
    """Sums over subtrees: keys, node (each node with anything at or below it), values. Node 0 (unclassified) keeps its own."""
    up = nodes.select(F.col("node_id").alias(node), F.transform("path", lambda a: a["id"]).alias("_up"))
    joined = counts.join(sized(up), node, "left").withColumn("_up", F.coalesce("_up", F.array(node)))
    return joined.select(*keys, F.explode("_up").alias(node), *values).groupBy(*keys, node).agg(*[F.sum(v).cast("bigint").alias(v) for v in values])


def leaves_below(nodes: DataFrame) -> DataFrame:
    """(ancestor, leaf)."""
    leaves = nodes.where("type = 'Leaf'")
    return leaves.select(F.explode("path").alias("_a"), F.col("node_id").alias("leaf")).select(F.col("_a.id").alias("ancestor"), "leaf")


def breadth_first(nodes: DataFrame) -> DataFrame:
    """(rank, node_id): by depth, then pre-order, which is the order in which a queue visits a binary tree's levels."""
    from pyspark.sql import Window

    return nodes.select("node_id", "depth", F.row_number().over(Window.orderBy("depth", "node_id")).alias("rank"))
