"""Counts per sample and node, roll-up, cutoffs, percentages and report shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeforge.operators import phylo


def counts(result: DataFrame) -> DataFrame:
    """(sample, node, sl, ml): reads on one lineage or unclassified, and split reads."""
    split = F.col("code") == "S"
    return result.groupBy("sample", "node").agg(F.sum(F.when(split, 0).otherwise(1)).cast("bigint").alias("sl"), F.sum(F.when(split, 1).otherwise(0)).cast("bigint").alias("ml"))


def on_all_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Zeros for every node and sample that has no row. Both tables of names are as small as a report."""
    ids = nodes.select(F.col("node_id").alias("node")).unionByName(nodes.sparkSession.createDataFrame([(0,)], "node int"))
    samples = found.groupBy().agg(F.collect_set("sample").alias("s"))  # the samples of one report
    grid = ids.withColumn("_one", F.lit(1)).join(F.broadcast(samples.withColumn("_one", F.lit(1))), "_one").select("node", F.explode("s").alias("sample"))
    return grid.join(found, ["sample", "node"], "left").na.fill(0)


def percent(count: Column, total: Column) -> Column:
    return F.concat(F.round(count * 100.0 / total, 3).cast("string"), F.lit(" %"))


def least_count(total: Column, cpm: float) -> Column:
    return F.floor(total * F.lit(float(cpm)) / F.lit(1e6)).cast("bigint")


def summarise(found: DataFrame, nodes: DataFrame, cpm: float = 100.0) -> DataFrame:
    """(sample, node, c_perc, c_cumul, c_count, s_..., t_...): rows whose total roll-up is above 0 after the cutoff."""
    own = found.select("sample", "node", F.col("sl").alias("c_count"), F.col("ml").alias("s_count"), (F.col("sl") + F.col("ml")).alias("t_count"))
    sums = own.select("sample", "node", F.col("c_count").alias("c_cumul"), F.col("s_count").alias("s_cumul"), F.col("t_count").alias("t_cumul"))
    rolled = phylo.roll_up(sums, nodes, ["sample"], ["c_cumul", "s_cumul", "t_cumul"])
    totals = own.groupBy("sample").agg(F.sum("t_count").alias("total"))
    rows = rolled.join(own, ["sample", "node"], "left").na.fill(0, ["c_count", "s_count", "t_count"]).join(phylo.sized(totals), "sample")
    rows = rows.withColumn("t_cumul", F.when(F.col("t_cumul") < least_count(F.col("total"), cpm), 0).otherwise(F.col("t_cumul"))).where("t_cumul > 0")
    columns = [c for x in "cst" for c in (percent(F.col(f"{x}_cumul"), F.col("total")).alias(f"{x}_perc"), F.col(f"{x}_cumul"), F.col(f"{x}_count"))]
    return rows.select("sample", "node", *columns)


def checked(sl: DataFrame, ml: DataFrame) -> None:
    """Two matrices belong together if they have the same samples in the same order."""
    if sl.columns != ml.columns:
        raise ValueError(f"the matrices have other samples: {sl.columns} and {ml.columns}")


def drop_zero_nodes(found: DataFrame) -> DataFrame:
    """Nodes that are 0 in all samples of either count go, but for unclassified (0)."""
    live = found.groupBy("node").agg(F.max(F.col("sl") + F.col("ml")).alias("m")).where("m > 0 or node = 0")
    return found.join(live.select("node"), "node", "left_semi")


def cpm_cutoff(found: DataFrame, cpm: float, value: str = "cnt") -> DataFrame:
    """Cells below a sample's least count become 0."""
    total = F.sum(value).over(Window.partitionBy("sample"))
    return found.withColumn(value, F.when(F.col(value) < least_count(total, cpm), 0).otherwise(F.col(value)))


def wide(found: DataFrame, value: str, samples: list[str]) -> DataFrame:
    """node by sample; samples are given, so no pass is needed to find them."""
    return found.groupBy("node").pivot("sample", samples).agg(F.sum(value)).na.fill(0)


def long(table: DataFrame, value: str) -> DataFrame:
    samples = [c for c in table.columns if c != "node"]
    return table.unpivot("node", samples, "sample", value)


def group_samples(found: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: (sample, group). The group's sum under its first member's name; samples without a group keep theirs."""
    first = groups.groupBy("group").agg(F.min("sample").alias("name"))
    names = groups.join(first, "group").select("sample", "name")
    return found.join(phylo.sized(names), "sample", "left").groupBy(F.coalesce("name", "sample").alias("sample"), "node").agg(F.sum("sl").alias("sl"), F.sum("ml").alias("ml"))


def add_frames(large: DataFrame, small: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums two tables by key; a key of only one keeps its values."""
    both = large.select(*keys, *values).unionByName(small.select(*keys, *values))
    return both.groupBy(*keys).agg(*[F.sum(v).cast("bigint").alias(v) for v in values])


def min_max(found: DataFrame, value: str = "cnt") -> DataFrame:
    return found.groupBy("sample").agg(F.max(value).alias("most"), F.min(F.when(F.col(value) > 0, F.col(value))).alias("least"))
