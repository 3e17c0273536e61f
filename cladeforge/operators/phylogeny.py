"""Tree building: sketches, distances and neighbour joining."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.functions import kmers
from cladeforge.operators.tree import Node, number_branches, write_newick


def hash_of(kmer: Column | str) -> Column:
    """An unsigned 60-bit hash from md5, so that another engine can make the same."""
    return F.conv(F.substring(F.md5(kmer), 1, 15), 16, 10).cast("bigint")


def sketch_scaled(genomes: DataFrame, k: int, scaled: int, name: str = "node_id") -> DataFrame:
    """(name, hash): hashes below 2^60 / scaled; what is kept does not depend on the genome's size."""
    found = kmers.explode_windows(genomes, [name], k).select(name, hash_of("kmer").alias("hash"))
    return found.where(F.col("hash") < F.lit((1 << 60) // scaled)).distinct()


def sketch_bottom(genomes: DataFrame, k: int, s: int, name: str = "node_id") -> DataFrame:
    """(name, hash): the s least hashes. The planner's group limit keeps each task's own s least before the shuffle."""
    found = kmers.explode_windows(genomes, [name], k).select(name, hash_of("kmer").alias("hash")).distinct()
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy("hash")))
    return ranked.where(F.col("_r") <= s).drop("_r")


def save_sketches(sketch: DataFrame, path: str) -> None:
    sketch.write.mode("overwrite").parquet(path)


def load_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def add_sketches(old: DataFrame, genomes: DataFrame, k: int, scaled: int, name: str = "node_id") -> DataFrame:
    """Only genomes that are not sketched yet are read."""
    missing = genomes.join(old.select(name).distinct(), name, "left_anti")
    return old.unionByName(sketch_scaled(missing, k, scaled, name))


def pairs(sketch: DataFrame, k: int, name: str = "node_id") -> DataFrame:
    """(a, b, shared, jaccard, distance) of all a < b with a shared hash. The join is on hashes; a pair without any has distance 1 and no row."""
    sizes = sketch.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    left, right = sketch.withColumnRenamed(name, "a"), sketch.withColumnRenamed(name, "b")
    shared = left.join(right, "hash").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(sizes.select(F.col(name).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(name).alias("b"), F.col("n").alias("nb")), "b")
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return both.withColumn("jaccard", j).withColumn("distance", mash_distance(F.col("jaccard"), k)).select("a", "b", "shared", "jaccard", "distance")


def pairs_bottom(sketch: DataFrame, k: int, s: int, name: str = "node_id") -> DataFrame:
    """Like :func:`pairs` for bottom sketches: of the ``s`` least hashes of both sketches together, the share that both have.

    A shared hash is in the union at the sum of its places in both sketches less the shared ones up to it."""
    ranked = sketch.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy("hash")))
    sizes = sketch.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    left, right = ranked.select("hash", F.col(name).alias("a"), F.col("_r").alias("ra")), ranked.select("hash", F.col(name).alias("b"), F.col("_r").alias("rb"))
    met = left.join(right, "hash").where("a < b").withColumn("upto", F.row_number().over(Window.partitionBy("a", "b").orderBy("hash")))
    found = met.groupBy("a", "b").agg(F.sum((F.col("ra") + F.col("rb") - F.col("upto") <= s).cast("int")).alias("shared"), F.count(F.lit(1)).alias("every"))
    both = found.join(sizes.select(F.col(name).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(name).alias("b"), F.col("n").alias("nb")), "b")
    j = F.col("shared") / F.least(F.lit(s), F.col("na") + F.col("nb") - F.col("every"))
    return both.withColumn("jaccard", j).withColumn("distance", mash_distance(F.col("jaccard"), k)).select("a", "b", "shared", "jaccard", "distance")


def mash_distance(j: Column, k: int) -> Column:
    """-1/k * ln(2j / (1 + j)); 1 without overlap, 0 for equal sketches."""
    return F.when(j <= 0, 1.0).when(j >= 1, 0.0).otherwise(F.least(F.lit(1.0), F.ln(2 * j / (1 + j)) * (-1.0 / k)))


def phylip(pairs_: DataFrame, names: DataFrame, name: str = "node_id") -> DataFrame:
    """(name, line): one row a name, distances in order of names; a tree's matrix is n by n by nature."""
    known = names.select(name).distinct()
    full = pairs_.select("a", "b", "distance").unionByName(pairs_.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    everyone = known.agg(F.sort_array(F.collect_set(name)).alias("_all"))
    grid = known.withColumnRenamed(name, "a").withColumn("_one", F.lit(1)).join(F.broadcast(everyone.withColumn("_one", F.lit(1))), "_one").select("a", F.explode("_all").alias("b"))
    cells = grid.join(full, ["a", "b"], "left").withColumn("distance", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce("distance", F.lit(1.0))))
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "distance"))), lambda x: F.format_number(x["distance"], 6)), "\t")
    return cells.groupBy("a").agg(row.alias("_row")).select(F.col("a").alias(name), F.concat_ws("\t", F.col("a").cast("string"), "_row").alias("line"))


def matrix_of(pairs_: DataFrame, names: list) -> np.ndarray:
    """The driver's matrix for neighbour joining."""
    at = {n: i for i, n in enumerate(names)}
    d = np.ones((len(names), len(names)))
    np.fill_diagonal(d, 0)
    for r in pairs_.select("a", "b", "distance").toLocalIterator():
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["distance"]
    return d


def neighbour_joining(d: np.ndarray, names: list[str], most: int = 5000) -> Node:
    """Saitou and Nei's method on the driver, n of at most ``most``; the last two nodes meet at a root half-way."""
    if len(names) > most:
        raise ValueError(f"{len(names)} names; at most {most} fit the driver")
    d, live = np.array(d, float), [Node(str(n)) for n in names]
    while len(live) > 2:
        n = len(live)
        total = d.sum(1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(np.argmin(q), q.shape))
        left = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        live[i].distance, live[j].distance = max(0.0, float(left)), max(0.0, float(d[i, j] - left))
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [x for x in range(n) if x not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
        live = [live[x] for x in keep] + [Node(None, 0.0, [live[i], live[j]])]
    if len(live) == 2:
        live[0].distance = live[1].distance = float(d[0, 1]) / 2
        return number_branches(Node(None, 0.0, live))
    return live[0]


def build_tree(genomes: DataFrame, k: int, scaled: int = 1, name: str = "node_id") -> str:
    """Sketch, distances and neighbour joining in one go: Newick."""
    sketch = sketch_scaled(genomes, k, scaled, name).persist()
    names = [r[0] for r in genomes.select(name).distinct().orderBy(name).collect()]
    labels = [f"ref{n}" if str(n).isdigit() else str(n) for n in names]  # numbers name branches
    root = neighbour_joining(matrix_of(pairs(sketch, k, name), names), labels)
    sketch.unpersist()
    return write_newick(root)
