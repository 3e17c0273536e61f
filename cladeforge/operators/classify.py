"""Classification of reads by a lineage vote over their k-mers' nodes.

A read of n valid k-mers, m of them known: no known one gives U; any unknown one gives S. Counts of an ancestor go to one terminal, the greatest hit id
in its subtree. Candidates are terminals with at least ceil(float(alpha) * float(n)) k-mers: none gives S at the root, one its
terminal, several S at their lowest common ancestor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeforge.functions import kmers, names
from cladeforge.operators import phylo

ALPHA, CPM = 0.1, 100.0
KEYS = ["sample", "read_id"]


def read_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(sample, read_id, length, ordinal, kmer); a read without valid k-mers is one row of nulls, so nothing needs to join the reads again."""
    return kmers.explode_windows(reads.withColumn("length", F.length("seq")), [*KEYS, "length"], k, outer=True)


def look_up(found: DataFrame, table: DataFrame) -> DataFrame:
    """Adds node (null: unknown). Spark broadcasts a table that is known or turns out to be below its threshold, shuffles a larger one, and meets a bucketed one in its buckets."""
    return found.join(table, "kmer", "left")


def node_counts(hits: DataFrame) -> DataFrame:
    """(sample, read_id, node, cnt) of known k-mers."""
    return hits.where("node is not null").groupBy(*KEYS, "node").agg(F.count(F.lit(1)).alias("cnt"))


RUNS = "array<struct<node:int,cnt:bigint>>"


def _runs(nodes: Column) -> Column:
    """Runs of equal nodes of an ordered array."""

    def one(node: Column, cnt: Column) -> Column:
        return F.array(F.struct(node.cast("int").alias("node"), cnt.cast("bigint").alias("cnt"))).cast(RUNS)

    def step(acc: Column, node: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(last["node"] == node, F.concat(F.slice(acc, 1, F.size(acc) - 1), one(node, last["cnt"] + 1))).otherwise(F.concat(acc, one(node, F.lit(1))))

    return F.aggregate(nodes, F.array().cast(RUNS), step)


def run_lengths(hits: DataFrame) -> DataFrame:
    """(sample, read_id, hits): runs of equal nodes in read order; unknown k-mers neither break nor join a run's order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "node"))), lambda x: x["node"])
    return hits.where("node is not null").groupBy(*KEYS).agg(ordered.alias("_nodes")).select(*KEYS, _runs(F.col("_nodes")).alias("hits"))


def vote(hits: DataFrame, nodes: DataFrame, alpha: float = ALPHA, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sample, read_id, code, node, n, m) from looked-up k-mers, and the columns of the read to keep.

    Counts are combined before the shuffle on the read; the vote is then one array expression a read."""
    keys = [*KEYS, *keep]
    counted = hits.groupBy(*keys, "node").agg(F.count("kmer").alias("cnt"))
    ends = nodes.select(F.col("node_id").alias("node"), F.col("subtree_end").alias("end"))
    counted = counted.join(phylo.sized(ends), "node", "left")
    known = F.col("node").isNotNull()
    per = counted.groupBy(*keys).agg(
        F.sum("cnt").cast("bigint").alias("n"), F.coalesce(F.sum(F.when(known, F.col("cnt"))), F.lit(0)).cast("bigint").alias("m"), F.collect_list(F.when(known, F.struct("node", "end", "cnt"))).alias("h")
    )
    return _decide(per, nodes, alpha).select(*keys, "code", "node", "n", "m")


def _decide(per: DataFrame, nodes: DataFrame, alpha: float) -> DataFrame:
    """Adds code and node to rows of n, m and h (array of node, end of its subtree, cnt)."""
    target = F.transform("h", lambda x: F.struct(F.array_max(F.transform(F.filter("h", lambda y: (y["node"] >= x["node"]) & (y["node"] <= x["end"])), lambda y: y["node"])).alias("t"), x["cnt"].alias("cnt")))
    per = per.withColumn("_t", target).withColumn("required", F.ceil(F.lit(alpha).cast("float") * F.col("n").cast("float")))
    credit = lambda t: F.aggregate(F.filter("_t", lambda x: x["t"] == t), F.lit(0).cast("bigint"), lambda a, x: a + x["cnt"])
    candidates = F.filter(F.array_distinct(F.transform("_t", lambda x: x["t"])), lambda t: credit(t) >= F.col("required"))
    per = per.withColumn("_c", candidates).withColumn("lo", F.array_min("_c")).withColumn("hi", F.array_max("_c"))
    per = phylo.lca_pairs(per, nodes, "lo", "hi", "_lca")
    code = F.when(F.col("m") == 0, "U").when((F.col("m") < F.col("n")) | (F.size("_c") != 1), "S").otherwise("C")
    node = F.when(F.col("m") == 0, 0).when(F.size("_c") == 0, 1).otherwise(F.col("_lca"))
    return per.withColumn("code", code).withColumn("node", node.cast("int"))


def classify(reads: DataFrame, table: DataFrame, nodes: DataFrame, k: int, alpha: float = ALPHA, with_hits: bool = True) -> DataFrame:
    """read_result: sample, code, read_id, node, length, hits."""
    return classify_hits(look_up(read_kmers(reads, k), table), nodes, alpha, with_hits)


def classify_hits(hits: DataFrame, nodes: DataFrame, alpha: float = ALPHA, with_hits: bool = True) -> DataFrame:
    """read_result of looked-up k-mers. With hits, one aggregate keeps a read's nodes in order, and the vote's counts come from its runs: the lookup is not made twice."""
    if not with_hits:
        return vote(hits, nodes, alpha, ("length",)).select("sample", "code", "read_id", "node", "length")
    ends = nodes.select(F.col("node_id").alias("node"), F.col("subtree_end").alias("end"))
    found = F.when(F.col("node").isNotNull(), F.struct("ordinal", "node", "end"))
    per = hits.join(phylo.sized(ends), "node", "left").groupBy(*KEYS, "length").agg(F.count("kmer").alias("n"), F.sort_array(F.collect_list(found)).alias("_o"))
    per = per.withColumn("m", F.size("_o").cast("bigint")).withColumn("hits", _runs(F.transform("_o", lambda x: x["node"])))
    distinct = F.array_distinct(F.transform("_o", lambda x: F.struct(x["node"].alias("node"), x["end"].alias("end"))))
    total = lambda x: F.aggregate(F.filter("hits", lambda r: r["node"] == x["node"]), F.lit(0).cast("bigint"), lambda a, r: a + r["cnt"])
    per = per.withColumn("h", F.transform(distinct, lambda x: F.struct(x["node"].alias("node"), x["end"].alias("end"), total(x).alias("cnt"))))
    return _decide(per, nodes, alpha).select("sample", "code", "read_id", "node", "length", "hits")


def raw_rows(result: DataFrame) -> DataFrame:
    """The text columns of a raw report: code, read_id, p<node>, length, hits."""
    return result.select("sample", "code", "read_id", F.concat(F.lit("p"), F.col("node").cast("string")).alias("node"), "length", F.coalesce(names.hits_text("hits"), F.lit("")).alias("hits"))
