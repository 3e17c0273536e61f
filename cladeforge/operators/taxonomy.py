"""Taxonomy: lineages, taxids of clades by the common prefix of their leaves' lineages, roll-up by taxid, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.operators import cuts, phylo

# Rank names in order, from the root down.
RANKS = (
    "superkingdom kingdom subkingdom superphylum phylum subphylum infraphylum superclass class subclass infraclass cohort subcohort superorder order suborder "
    "infraorder parvorder superfamily family subfamily tribe subtribe genus subgenus section subsection series species group species subgroup species forma "
    "subspecies varietas strain"
)


def lineages(taxonomy: DataFrame) -> DataFrame:
    """(taxid, lineage from the root down). taxonomy: taxid, parent (null or itself at a root). Taxa on a cycle or below an unknown parent have no root and no lineage."""
    return cuts.chains(taxonomy, "taxid", "parent", F.col("taxid"), "lineage")


def common_prefixes(nodes: DataFrame, leaf_lineages: DataFrame) -> DataFrame:
    """(node, taxid): the last taxid that all leaves of a clade have at the same place from the root on. leaf_lineages: (leaf, lineage)."""
    below = phylo.leaves_below(nodes).join(leaf_lineages, "leaf")
    places = below.select(F.col("ancestor").alias("node"), F.posexplode("lineage").alias("pos", "taxid"))
    leaves = below.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    at = places.groupBy("node", "pos").agg(F.count(F.lit(1)).alias("have"), F.min("taxid").alias("taxid"), F.max("taxid").alias("other")).join(leaves, "node")
    at = at.withColumn("same", (F.col("have") == F.col("n")) & (F.col("taxid") == F.col("other")))
    ends = at.groupBy("node").agg(F.min(F.when(~F.col("same"), F.col("pos"))).alias("stop"))
    return at.join(ends, "node").where("stop is null or pos < stop").groupBy("node").agg(F.max_by("taxid", "pos").alias("taxid"))


def missing_taxids(leaves: DataFrame, leaf_taxids: DataFrame) -> DataFrame:
    """Leaves without a taxid; a taxonomy can be mapped only where there are none."""
    return leaves.join(leaf_taxids.where("taxid is not null and taxid not in ('', 'None')"), "name", "left_anti")


def edges(lines: DataFrame) -> DataFrame:
    """Distinct (parent, child) of lineages."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("lineage") - 1), lambda i: F.struct(F.element_at("lineage", i).alias("parent"), F.element_at("lineage", i + 1).alias("child")))
    return lines.where(F.size("lineage") > 1).select(F.explode(pairs).alias("e")).select("e.parent", "e.child").distinct()


def pool(lines: DataFrame) -> DataFrame:
    """(taxid, depth): parents come before children in order of depth."""
    return lines.select(F.posexplode("lineage").alias("depth", "taxid")).groupBy("taxid").agg(F.min("depth").alias("depth"))


def by_taxid(counts: DataFrame, clade_taxid: DataFrame) -> DataFrame:
    """(sample, taxid, sl, ml); node 0 is unclassified."""
    named = counts.join(phylo.sized(clade_taxid), "node", "left").withColumn("taxid", F.when(F.col("node") == 0, "unclassified").otherwise(F.col("taxid")))
    return named.groupBy("sample", "taxid").agg(F.sum("sl").cast("bigint").alias("sl"), F.sum("ml").cast("bigint").alias("ml"))


def roll_up(counts: DataFrame, lines: DataFrame, values: tuple[str, ...] = ("sl", "ml")) -> DataFrame:
    """Sums over all taxids below: each row goes to every taxid of its lineage; unclassified keeps its own."""
    joined = counts.join(lines, "taxid", "left").withColumn("up", F.coalesce("lineage", F.array("taxid")))
    return joined.select("sample", F.explode("up").alias("taxid"), *values).groupBy("sample", "taxid").agg(*[F.sum(v).cast("bigint").alias(v) for v in values])


def convert_raw(result: DataFrame, clade_taxid: DataFrame) -> DataFrame:
    """code, read_id, taxid (NA where unclassified), length."""
    joined = result.join(phylo.sized(clade_taxid), "node", "left")
    return joined.select("sample", "code", "read_id", F.when(F.col("code") == "U", "NA").otherwise(F.coalesce("taxid", F.lit("NA"))).alias("taxid"), "length")


def attach(frame: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return frame.join(taxonomy.select("taxid", "rank", F.col("name").alias("scientific_name")), "taxid", "left")


def at_rank(lines: DataFrame, taxonomy: DataFrame, rank: str) -> DataFrame:
    """(taxid, ancestor): the ancestor of that rank; null if there is none."""
    up = lines.select("taxid", F.explode("lineage").alias("ancestor"))
    ranked = up.join(taxonomy.where(F.col("rank") == rank).select(F.col("taxid").alias("ancestor")), "ancestor").select("taxid", "ancestor")
    return lines.select("taxid").join(ranked, "taxid", "left")


def rank_table(lines: DataFrame, taxonomy: DataFrame, ranks: list[str]) -> DataFrame:
    """taxid by rank."""
    up = lines.select("taxid", F.explode("lineage").alias("up")).join(taxonomy.select(F.col("taxid").alias("up"), "rank"), "up")
    return up.groupBy("taxid").pivot("rank", ranks).agg(F.max("up"))


def fill_up(table: DataFrame, ranks: list[str]) -> DataFrame:
    """An empty rank takes the value of the next lower one that has any; ranks from the root down."""
    columns = [F.coalesce(*[F.col(r) for r in ranks[i:]]).alias(ranks[i]) if i + 1 < len(ranks) else F.col(ranks[-1]) for i in range(len(ranks))]
    return table.select(*[c for c in table.columns if c not in ranks], *columns)


def nearest_known(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(taxid, nearest): the lowest taxid of the lineage that ``known`` has."""
    up = lines.select("taxid", F.posexplode("lineage").alias("pos", "up"))
    return up.join(known.select(F.col("taxid").alias("up")), "up", "left_semi").groupBy("taxid").agg(F.max_by("up", "pos").alias("nearest"))


def drop_bad(rows: DataFrame, bad: DataFrame) -> DataFrame:
    return rows.join(bad.select("taxid"), "taxid", "left_anti")


def replace(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: (taxid, new)."""
    return rows.join(mapping, "taxid", "left").withColumn("taxid", F.coalesce("new", "taxid")).drop("new")


def clade_table(clade_taxid: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return clade_taxid.join(taxonomy, "taxid", "left").select(F.col("node").alias("clade"), "taxid", F.col("name").alias("taxa"), "rank")


def changed_lineages(table: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each lineage, told by the columns in ``order``: what is left if rows whose lineage is that of the row before go. No row order is needed."""
    return table.dropDuplicates(order)
