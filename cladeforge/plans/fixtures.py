"""Deterministic sequence tables made from the star-schema tables, so that any engine can make the same rows.

Regions are branches and nations leaves of a tree; a genome's 450 characters are a stretch of the root's, its region's and its own bases; a read is 60 bases of a nation's genome,
or foreign, chimeric or with one changed base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.operators.tree import local_frame

K = 15


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(owner: Column, n: int) -> Column:
    return F.translate(F.concat(*[F.md5(F.concat(owner, F.lit(f"-{i + 1}"))) for i in range(n)]), "0123456789abcdef", "ACGTACGTACGTACGT")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, name, type, parent, subtree_end, depth, path. Trees are driver objects: 5 regions and 25 nations."""
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()
    nation = sorted(load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").collect())
    rows = [(1, "root", "Branch", None, 31, 0, [(1, 31)])]
    for key, name in region:
        top = 2 + 6 * key
        rows.append((top, name, "Branch", 1, top + 5, 1, [(1, 31), (top, top + 5)]))
        for i, (_, _, leaf) in enumerate([n for n in nation if n[0] == key], 1):
            rows.append((top + i, leaf, "Leaf", top, top + i, 2, [(1, 31), (top, top + 5), (top + i, top + i)]))
    return local_frame(spark, rows, "node_id int, name string, type string, parent int, subtree_end int, depth int, path array<struct<id:int,end:int>>")


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nk, n_regionkey, node_id)."""
    own = (F.lit(2) + F.col("n_regionkey") * 6 + F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).cast("int")
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), "n_regionkey", own.alias("node_id"))


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nk, node_id, seq)."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    seq = F.concat_ws("N", dna(F.lit("root"), 2), dna(name("r", "n_regionkey"), 4), dna(name("n", "nk"), 8))
    return leaves(spark, sf_dir).select("nk", "node_id", seq.alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, read_id, seq, nk): seq ends in N; nk is the nation it was drawn from."""
    own = genomes(spark, sf_dir)
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    both = c.join(F.broadcast(own.select(F.col("nk").alias("c_nationkey"), F.col("seq").alias("own"))), "c_nationkey")  # 25 genomes
    both = both.withColumn("ok", (F.col("c_nationkey") + 7) % 25).join(F.broadcast(own.select(F.col("nk").alias("ok"), F.col("seq").alias("other"))), "ok")
    key = F.col("c_custkey")
    start = (F.lit(1) + (key * 37) % 390).cast("int")
    text = F.col("own")
    changed = F.concat(F.substring(text, start, F.lit(29)), F.translate(F.substring(text, start + 29, F.lit(1)), "ACGT", "TGCA"), F.substring(text, start + 30, F.lit(30)))
    seq = (
        F.when(key % 11 == 0, F.substring(dna(F.concat(F.lit("x"), key.cast("string")), 2), 1, 60))
        .when(key % 13 == 0, F.concat(F.substring(text, 300, 30), F.substring("other", 300, 30)))
        .when(key % 7 == 0, changed)
        .otherwise(F.substring(text, start, F.lit(60)))
    )
    return both.select(F.col("c_mktsegment").alias("sample"), F.concat(F.lit("R"), key.cast("string")).alias("read_id"), F.concat(seq, F.lit("N")).alias("seq"), F.col("c_nationkey").alias("nk"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxid, parent, rank, name)."""
    n = nodes(spark, sf_dir)
    taxid = lambda c: F.when(F.col(c) == 1, "1").otherwise((F.col(c) + 1000).cast("string"))
    rank = F.when(F.col("depth") == 0, "no rank").when(F.col("depth") == 1, "superkingdom").otherwise("species")
    return n.select(taxid("node_id").alias("taxid"), F.when(F.col("parent").isNotNull(), taxid("parent")).alias("parent"), rank.alias("rank"), "name")


# The same tables in SQL, as common table expressions.
_DNA = "translate(concat({parts}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _dna_sql(owner: str, n: int) -> str:
    return _DNA.format(parts=", ".join(f"md5({owner} || '-{i + 1}')" for i in range(n)))


RC = "reverse(translate({x}, 'ACGT', 'TGCA'))"

FX_SQL = f"""
fx_leaves AS (
  SELECT n_nationkey AS nk, n_regionkey, CAST(2 + n_regionkey * 6 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS node_id, n_name FROM nation
), fx_nodes AS (
  SELECT 1 AS node_id, 'root' AS name, 'Branch' AS type, CAST(NULL AS INTEGER) AS parent, 31 AS subtree_end, 0 AS depth
  UNION ALL SELECT CAST(2 + r_regionkey * 6 AS INTEGER), r_name, 'Branch', 1, CAST(7 + r_regionkey * 6 AS INTEGER), 1 FROM region
  UNION ALL SELECT node_id, n_name, 'Leaf', CAST(2 + n_regionkey * 6 AS INTEGER), node_id, 2 FROM fx_leaves
), fx_genomes AS (
  SELECT nk, node_id, {_dna_sql("'root'", 2)} || 'N' || {_dna_sql("('r' || n_regionkey)", 4)} || 'N' || {_dna_sql("('n' || nk)", 8)} AS seq FROM fx_leaves
), fx_reads0 AS (
  SELECT c_mktsegment AS sample, 'R' || c_custkey AS read_id, c_nationkey AS nk, c_custkey AS key, CAST(1 + (c_custkey * 37) % 390 AS INTEGER) AS p, a.seq AS own, b.seq AS other
  FROM customer JOIN fx_genomes a ON a.nk = c_nationkey JOIN fx_genomes b ON b.nk = (c_nationkey + 7) % 25
), fx_reads AS (
  SELECT sample, read_id, nk, (CASE WHEN key % 11 = 0 THEN substr({_dna_sql("('x' || key)", 2)}, 1, 60)
    WHEN key % 13 = 0 THEN substr(own, 300, 30) || substr(other, 300, 30)
    WHEN key % 7 = 0 THEN substr(own, p, 29) || translate(substr(own, p + 29, 1), 'ACGT', 'TGCA') || substr(own, p + 30, 30)
    ELSE substr(own, p, 60) END) || 'N' AS seq FROM fx_reads0
), fx_closure AS (
  SELECT a.node_id AS ancestor, d.node_id AS descendant, d.depth - a.depth AS dist FROM fx_nodes a JOIN fx_nodes d ON d.node_id BETWEEN a.node_id AND a.subtree_end
), fx_taxonomy AS (
  SELECT CASE WHEN node_id = 1 THEN '1' ELSE CAST(node_id + 1000 AS VARCHAR) END AS taxid,
    CASE WHEN parent = 1 THEN '1' ELSE CAST(parent + 1000 AS VARCHAR) END AS parent,
    CASE depth WHEN 0 THEN 'no rank' WHEN 1 THEN 'superkingdom' ELSE 'species' END AS rank, name, node_id FROM fx_nodes
)"""

KMER_SQL = f"""
gk0 AS (SELECT node_id, CAST(i - 1 AS INTEGER) AS pos, substr(seq, i, {K}) AS word FROM (SELECT node_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM fx_genomes)),
gk AS (SELECT node_id, pos, word, least(word, {RC.format(x="word")}) AS kmer FROM gk0 WHERE regexp_matches(word, '^[ACGT]+$')),
db0 AS (SELECT kmer, min(node_id) AS lo, max(node_id) AS hi FROM gk GROUP BY kmer),
db AS (SELECT kmer, max(n.node_id) AS node FROM db0 JOIN fx_nodes n ON n.node_id <= lo AND hi <= n.subtree_end GROUP BY kmer)"""

HITS_SQL = f"""
rk0 AS (SELECT sample, read_id, seq, i, substr(seq, i, {K}) AS word FROM (SELECT sample, read_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM fx_reads)),
rk AS (SELECT sample, read_id, length(seq) AS length, i, least(word, {RC.format(x="word")}) AS kmer FROM rk0 WHERE regexp_matches(word, '^[ACGT]+$')),
hits AS (SELECT rk.*, db.node FROM rk LEFT JOIN db USING (kmer)),
nm AS (SELECT r.sample, r.read_id, length(r.seq) AS length, count(h.kmer) AS n, count(h.node) AS m FROM fx_reads r LEFT JOIN hits h USING (sample, read_id) GROUP BY ALL),
hc AS (SELECT sample, read_id, node, count(*) AS cnt FROM hits WHERE node IS NOT NULL GROUP BY ALL)"""


def vote_sql(alpha: str) -> str:
    return f"""
target AS (SELECT x.sample, x.read_id, x.node, x.cnt, max(y.node) AS t FROM hc x JOIN fx_nodes f ON f.node_id = x.node
  JOIN hc y ON x.sample = y.sample AND x.read_id = y.read_id AND y.node BETWEEN x.node AND f.subtree_end GROUP BY ALL),
credit AS (SELECT sample, read_id, t, sum(cnt) AS c FROM target GROUP BY ALL),
cand AS (SELECT sample, read_id, count(*) AS k, min(t) AS lo, max(t) AS hi FROM credit JOIN nm USING (sample, read_id)
  WHERE c >= ceil(CAST({alpha} AS FLOAT) * CAST(n AS FLOAT)) GROUP BY ALL),
anc AS (SELECT sample, read_id, k, max(f.node_id) AS lca FROM cand JOIN fx_nodes f ON f.node_id <= lo AND hi <= f.subtree_end GROUP BY ALL),
vote AS (SELECT sample, read_id, length, n, m,
  CASE WHEN m = 0 THEN 'U' WHEN m < n OR coalesce(k, 0) <> 1 THEN 'S' ELSE 'C' END AS code,
  CAST(CASE WHEN m = 0 THEN 0 WHEN k IS NULL THEN 1 ELSE lca END AS INTEGER) AS node FROM nm LEFT JOIN anc USING (sample, read_id)),
cnt AS (SELECT sample, node, CAST(sum(CASE WHEN code = 'S' THEN 0 ELSE 1 END) AS BIGINT) AS sl, CAST(sum(CASE WHEN code = 'S' THEN 1 ELSE 0 END) AS BIGINT) AS ml FROM vote GROUP BY ALL)"""


def sql(body: str, kmers: bool = False, hits: bool = False, vote: str | None = None) -> str:
    parts = [FX_SQL]
    if kmers or hits or vote:
        parts.append(KMER_SQL)
    if hits or vote:
        parts.append(HITS_SQL)
    if vote:
        parts.append(vote_sql(vote))
    body = body.strip()
    return "WITH " + ",".join(parts) + ("," + body[4:] if body.upper().startswith("WITH") else "\n" + body)
