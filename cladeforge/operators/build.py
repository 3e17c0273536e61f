"""The k-mer table: every canonical k-mer with the lowest common ancestor of the genomes that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.functions import kmers
from cladeforge.operators import phylo


def genome_kmers(genomes: DataFrame, k: int, arrow: bool = False) -> DataFrame:
    """(node_id, kmer), distinct within each genome. Strings, or codes by the Arrow path."""
    if arrow:
        found = kmers.explode_codes(genomes, ["node_id"], k).select("node_id", F.col("code").alias("kmer"))
    else:
        found = kmers.explode_windows(genomes, ["node_id"], k).select("node_id", "kmer")
    return found.distinct()


def kmer_table(genomes: DataFrame, nodes: DataFrame, k: int, arrow: bool = False) -> DataFrame:
    """(kmer, node). Pre-order ids make the ancestor of a set that of its least and greatest id, so min and max are the whole aggregate, combined
    before the shuffle; ancestors are then looked up for the k-mers of several genomes."""
    found = kmers.explode_codes(genomes, ["node_id"], k).withColumnRenamed("code", "kmer") if arrow else kmers.explode_windows(genomes, ["node_id"], k)
    ends = found.groupBy("kmer").agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    return phylo.lca_pairs(ends, nodes, "lo", "hi", "node").select("kmer", F.col("node").cast("int").alias("node"))


def first_offsets(genomes: DataFrame, k: int) -> DataFrame:
    """(node_id, kmer, first_pos) of distinct k-mers."""
    found = kmers.explode_offsets(genomes, ["node_id"], k)
    return found.withColumn("kmer", kmers.canonical("word")).groupBy("node_id", "kmer").agg(F.min("pos").alias("first_pos"))


def new_kmers(found: DataFrame, known: DataFrame) -> DataFrame:
    """k-mers of ``found`` that ``known`` has not."""
    return found.select("kmer").distinct().join(known.select("kmer"), "kmer", "left_anti")


def key_ranges(n: int, k: int) -> list[tuple[int, int, int]]:
    """(worker, low, high): n half-open ranges of codes; the last one includes the largest code."""
    top = kmers.largest_code(k)
    step = top // n
    return [(i, i * step, (i + 1) * step if i < n - 1 else top + 1) for i in range(n)]


def route(found: DataFrame, n: int, k: int, code: str = "code") -> DataFrame:
    """Adds worker: the range that a code falls in, by arithmetic and not by a join."""
    step = kmers.largest_code(k) // n
    return found.withColumn("worker", F.least(F.floor(F.col(code) / F.lit(step)), F.lit(n - 1)).cast("int"))


def save_table(table: DataFrame, path: str, partitions: int | None = None) -> None:
    """Range-partitioned by k-mer and sorted, so that a range of k-mers reads few row groups. Sampling evens out the ranges."""
    dealt = table.repartitionByRange(partitions, "kmer") if partitions else table.repartitionByRange("kmer")
    dealt.sortWithinPartitions("kmer").write.mode("overwrite").parquet(path)


def save_bucketed(table: DataFrame, name: str, buckets: int) -> None:
    """A warehouse table bucketed by k-mer: read k-mers then meet it without shuffling it again."""
    table.write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer").saveAsTable(name)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def database_size(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_kmers"))


def unique_per_genome(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_unique): k-mers of the table that only that leaf has."""
    leaves = nodes.where("type = 'Leaf'").select(F.col("node_id").alias("node"))
    return table.join(phylo.sized(leaves), "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n_unique"))


def duplicity(genomes: DataFrame, table: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, n_unique, n_seen, duplicity): occurrences of each leaf's unique k-mers in its genome, by unique k-mer."""
    unique = unique_per_genome(table, nodes)
    own = table.withColumnRenamed("node", "node_id")
    seen = kmers.explode_windows(genomes, ["node_id"], k).join(own, ["kmer", "node_id"], "left_semi").groupBy(F.col("node_id").alias("node")).agg(F.count(F.lit(1)).alias("n_seen"))
    return unique.join(seen, "node").withColumn("duplicity", F.round(F.col("n_seen") / F.col("n_unique"), 6))


def contigs(genomes: DataFrame, longer_than: int) -> DataFrame:
    """(node_id, contig, n): pieces between N longer than a limit."""
    return genomes.select("node_id", F.posexplode(F.split("seq", "N")).alias("contig", "s")).where(F.length("s") > longer_than).select("node_id", "contig", F.length("s").alias("n"))


def ordinals(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(order)))
