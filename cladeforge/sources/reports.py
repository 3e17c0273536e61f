"""Reports and tables on disk: raw rows, summaries, matrices, PHYLIP, accession ids, taxonomy dumps, drawing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.functions import names
from cladeforge.operators import classify, phylo, results


def write_raw(result: DataFrame, path: str) -> None:
    """A folder a sample of tab-separated raw rows."""
    classify.raw_rows(result).write.mode("overwrite").partitionBy("sample").option("sep", "\t").csv(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("code string, read_id string, node string, length int, hits string, sample string").option("sep", "\t").csv(path)


def write_csv(frame: DataFrame, path: str, header: bool = True, one_file: bool = False) -> None:
    (frame.coalesce(1) if one_file else frame).write.mode("overwrite").option("header", header).csv(path)


def labelled(frame: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node column as report labels: p<number> for branches, names for leaves, unclassified for 0."""
    own = nodes.select(F.col("node_id").alias("node"), names.node_label(F.col("name"), F.col("type")).alias("label"))
    return frame.join(phylo.sized(own), "node", "left").withColumn("label", F.when(F.col("node") == 0, "unclassified").otherwise(F.col("label")))


def matrix(found: DataFrame, value: str, samples: list[str], nodes: DataFrame | None = None, keep_zeros: bool = False) -> DataFrame:
    """Node by sample. With ``nodes``, rows go by their labels; the split matrix (value ml) has no unclassified row, as no unclassified read is split."""
    kept = found if keep_zeros else results.drop_zero_nodes(found)
    table = results.wide(kept if value != "ml" else kept.where("node <> 0"), value, samples)
    return table.orderBy("node") if nodes is None else labelled(table, nodes).orderBy("node").select("label", *samples)


def write_matrix(found: DataFrame, value: str, samples: list[str], path: str, keep_zeros: bool = False, nodes: DataFrame | None = None) -> None:
    write_csv(matrix(found, value, samples, nodes, keep_zeros), path, one_file=True)


def read_matrix(spark: SparkSession, path: str, value: str, nodes: DataFrame | None = None) -> DataFrame:
    """Long form again, of numbered or labelled rows (which need ``nodes``); with ``nodes``, every node and sample, zeros filled in."""
    table = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if "label" in table.columns:
        own = nodes.select(F.col("node_id").alias("node"), names.node_label(F.col("name"), F.col("type")).alias("label"))
        table = table.withColumn("label", F.col("label").cast("string")).join(phylo.sized(own), "label", "left").withColumn("node", F.when(F.col("label") == "unclassified", 0).otherwise(F.col("node"))).drop("label")
    long = results.long(table, value).withColumn(value, F.col(value).cast("bigint")).withColumn("node", F.col("node").cast("int"))
    return results.on_all_nodes(long, nodes) if nodes is not None else long


def accession_ids(genomes: DataFrame) -> DataFrame:
    return genomes.select("name", F.coalesce("accession", F.lit("None")).alias("accession"), F.coalesce("taxid", F.lit("None")).alias("taxid"))


def read_dump(spark: SparkSession, nodes_path: str, names_path: str) -> DataFrame:
    """(taxid, parent, rank, name) of a taxonomy dump's nodes and names files."""
    cell = lambda i: F.trim(F.get(F.split("value", r"\t\|\t?"), F.lit(i)))
    own = spark.read.text(nodes_path).select(cell(0).alias("taxid"), cell(1).alias("parent"), cell(2).alias("rank"))
    called = spark.read.text(names_path).select(cell(0).alias("taxid"), cell(1).alias("name"), cell(3).alias("kind")).where("kind = 'scientific name'")
    return own.withColumn("parent", F.when(F.col("parent") == F.col("taxid"), None).otherwise(F.col("parent"))).join(called.select("taxid", "name"), "taxid", "left")


def drawing_rows(colours: DataFrame) -> DataFrame:
    """Lines of a tree-colour table from (label, colour)."""
    return colours.select(F.format_string("%s\trange\t#%s\tNODE", "label", "colour").alias("value"))


def write_drawing(colours: DataFrame, path: str) -> None:
    spark = colours.sparkSession
    head = spark.createDataFrame([(0, "TREE_COLORS"), (1, "SEPARATOR TAB"), (2, "DATA")], "o int, value string")
    lines = drawing_rows(colours).withColumn("o", F.lit(3))
    head.unionByName(lines).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def write_phylip(lines: DataFrame, n: int, path: str) -> None:
    head = lines.sparkSession.createDataFrame([(0, str(n))], "o int, line string")
    head.unionByName(lines.select(F.lit(1).alias("o"), "line")).coalesce(1).sortWithinPartitions("o", "line").select("line").write.mode("overwrite").text(path)
