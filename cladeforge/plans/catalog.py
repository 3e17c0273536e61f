"""The registered queries and, for each, the SQL that a second engine checks it with."""

from __future__ import annotations

import gzip
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.functions import colours, kmers, names
from cladeforge.operators import analytics, build, classify, cuts, drawing, phylo, phylogeny, results, taxonomy, tree
from cladeforge.plans import fixtures as fx
from cladeforge.plans.fixtures import K, load, sql
from cladeforge.sources import reports, sequences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, d: str) -> DataFrame:
    return build.kmer_table(fx.genomes(spark, d), fx.nodes(spark, d), K)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return classify.look_up(classify.read_kmers(fx.reads(spark, d), K), _table(spark, d))


def _votes(spark: SparkSession, d: str, alpha: float = classify.ALPHA) -> DataFrame:
    return classify.vote(_hits(spark, d), fx.nodes(spark, d), alpha)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return results.counts(_votes(spark, d))


def _leaf_lineages(spark: SparkSession, d: str) -> DataFrame:
    lines = taxonomy.lineages(fx.taxonomy(spark, d))
    return fx.nodes(spark, d).where("type = 'Leaf'").select(F.col("node_id").alias("leaf"), (F.col("node_id") + 1000).cast("string").alias("taxid")).join(lines, "taxid").select("leaf", "lineage")


def _clade_taxids(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.common_prefixes(fx.nodes(spark, d), _leaf_lineages(spark, d))


# ---- k-mers ----


@query(sql("SELECT node_id, pos, word FROM gk", kmers=True))
def kmer_extract(spark, d):
    return kmers.explode_offsets(fx.genomes(spark, d), ["node_id"], K)


@query(sql("SELECT node_id, kmer, count(*) AS n FROM gk GROUP BY ALL", kmers=True))
def kmer_canonical(spark, d):
    return kmers.explode_windows(fx.genomes(spark, d), ["node_id"], K).groupBy("node_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


_CODE = "list_reduce(list_transform(string_split(kmer, ''), lambda c: CASE c WHEN 'A' THEN 0::BIGINT WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END), lambda a, c: a * 4 + c)"


@query(sql(f"SELECT node_id, pos, kmer, {_CODE} AS code FROM gk", kmers=True))
def kmer_encode(spark, d):
    found = kmers.explode_offsets(fx.genomes(spark, d), ["node_id"], K)
    return found.select("node_id", "pos", kmers.canonical("word").alias("kmer")).withColumn("code", kmers.encode("kmer"))


@query(sql(f"SELECT node_id, CAST(pos AS BIGINT) AS pos, {_CODE} AS code FROM gk", kmers=True))
def kmer_codes_arrow(spark, d):
    return kmers.explode_codes(fx.genomes(spark, d), ["node_id"], K)


@query(sql(f"SELECT nk, {fx.RC.format(x='seq')} AS rc, seq || 'N' || {fx.RC.format(x='seq')} AS joined FROM fx_genomes"))
def kmer_revcomp(spark, d):
    return fx.genomes(spark, d).select("nk", kmers.reverse_complement("seq").alias("rc"), kmers.complement_join(F.col("seq"), F.col("seq")).alias("joined"))


@query(sql("SELECT node_id, count(*) AS n_windows, count(*) FILTER (regexp_matches(word, '^[ACGT]+$')) AS n_valid FROM gk0 GROUP BY ALL", kmers=True))
def kmer_valid_filter(spark, d):
    g = fx.genomes(spark, d)
    return g.select("node_id", (F.length("seq") - K + 1).cast("bigint").alias("n_windows"), F.size(kmers.windows("seq", K)).cast("bigint").alias("n_valid"))


@query(sql("SELECT node_id, count(DISTINCT kmer) AS n FROM gk GROUP BY ALL", kmers=True))
def genome_distinct_kmers(spark, d):
    return build.genome_kmers(fx.genomes(spark, d), K).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT node_id, kmer, min(pos) AS first_pos FROM gk GROUP BY ALL", kmers=True))
def kmer_first_offset(spark, d):
    return build.first_offsets(fx.genomes(spark, d), K)


@query(sql("SELECT DISTINCT kmer FROM gk", kmers=True))
def kmer_union(spark, d):
    return kmers.explode_windows(fx.genomes(spark, d), ["node_id"], K).select("kmer").distinct()


@query(sql("SELECT DISTINCT kmer FROM gk WHERE node_id % 2 = 0 AND kmer NOT IN (SELECT kmer FROM gk WHERE node_id % 2 = 1)", kmers=True))
def kmer_anti_new(spark, d):
    found = kmers.explode_windows(fx.genomes(spark, d), ["node_id"], K)
    return build.new_kmers(found.where("node_id % 2 = 0"), found.where("node_id % 2 = 1"))


@query(sql("SELECT k.kmer FROM (SELECT DISTINCT kmer FROM gk WHERE node_id <= 8) k INTERSECT SELECT kmer FROM gk WHERE node_id > 8", kmers=True))
def set_intersect(spark, d):
    found = kmers.explode_windows(fx.genomes(spark, d), ["node_id"], K)
    return found.where("node_id <= 8").select("kmer").intersect(found.where("node_id > 8").select("kmer"))


@query(sql("SELECT kmer FROM gk WHERE node_id <= 8 EXCEPT SELECT kmer FROM gk WHERE node_id > 8", kmers=True))
def set_except(spark, d):
    found = kmers.explode_windows(fx.genomes(spark, d), ["node_id"], K)
    return found.where("node_id <= 8").select("kmer").subtract(found.where("node_id > 8").select("kmer"))


@query(sql(f"SELECT CAST(least(code // {(4**K - 1) // 8}, 7) AS INTEGER) AS worker, count(*) AS n, min(code) AS lo, max(code) AS hi FROM (SELECT {_CODE} AS code FROM (SELECT DISTINCT kmer FROM gk)) GROUP BY ALL", kmers=True))
def kmer_range_partition(spark, d):
    found = kmers.explode_windows(fx.genomes(spark, d), ["node_id"], K).select("kmer").distinct().select(kmers.encode("kmer").alias("code"))
    return build.route(found, 8, K).groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"))


@query(sql("SELECT kmer, node FROM db", kmers=True))
def kmer_db_lca(spark, d):
    return _table(spark, d)


@query(sql("SELECT node, count(*) AS n FROM db GROUP BY ALL", kmers=True))
def kmer_db_arrow(spark, d):
    return build.kmer_table(fx.genomes(spark, d), fx.nodes(spark, d), K, arrow=True).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT count(*) AS n_kmers FROM db", kmers=True))
def database_size(spark, d):
    return build.database_size(_table(spark, d))


@query(sql("SELECT node, count(*) AS n_unique FROM db JOIN fx_nodes ON node = node_id WHERE type = 'Leaf' GROUP BY ALL", kmers=True))
def unique_kmers_per_genome(spark, d):
    return build.unique_per_genome(_table(spark, d), fx.nodes(spark, d))


@query(
    sql(
        """WITH u AS (SELECT kmer, node FROM db JOIN fx_nodes ON node = node_id WHERE type = 'Leaf'),
a AS (SELECT node, count(*) AS n_unique FROM u GROUP BY ALL), b AS (SELECT u.node, count(*) AS n_seen FROM gk JOIN u ON gk.kmer = u.kmer AND gk.node_id = u.node GROUP BY ALL)
SELECT node, n_unique, n_seen, round(CAST(n_seen AS DOUBLE) / n_unique, 6) AS duplicity FROM a JOIN b USING (node)""",
        kmers=True,
    )
)
def kmer_duplicity(spark, d):
    return build.duplicity(fx.genomes(spark, d), _table(spark, d), fx.nodes(spark, d), K)


@query(sql("SELECT node_id, CAST(i - 1 AS INTEGER) AS contig, CAST(length(s) AS INTEGER) AS n FROM (SELECT node_id, unnest(string_split(seq, 'N')) AS s, unnest(range(1, 4)) AS i FROM fx_genomes) WHERE length(s) > 100"))
def contig_split(spark, d):
    return build.contigs(fx.genomes(spark, d), 100)


# ---- trees ----


@query(sql("SELECT ancestor, descendant, dist FROM fx_closure"))
def tree_closure(spark, d):
    return phylo.closure(fx.nodes(spark, d))


@query(sql("SELECT ancestor, descendant AS leaf FROM fx_closure JOIN fx_nodes ON descendant = node_id WHERE type = 'Leaf'"))
def tree_leaves(spark, d):
    return phylo.leaves_below(fx.nodes(spark, d))


@query(sql("SELECT node_id, depth, CAST(row_number() OVER (ORDER BY depth, node_id) AS INTEGER) AS rank FROM fx_nodes"))
def tree_bfs(spark, d):
    return phylo.breadth_first(fx.nodes(spark, d))


@query(sql("SELECT ancestor AS node_id, count(*) - 1 AS nchildren FROM fx_closure GROUP BY ALL"))
def tree_nchildren(spark, d):
    return phylo.closure(fx.nodes(spark, d)).groupBy(F.col("ancestor").alias("node_id")).agg((F.count(F.lit(1)) - 1).alias("nchildren"))


@query(sql("SELECT a.node_id AS lo, b.node_id AS hi, max(f.node_id) AS lca FROM fx_nodes a JOIN fx_nodes b ON a.node_id <= b.node_id JOIN fx_nodes f ON f.node_id <= a.node_id AND b.node_id <= f.subtree_end GROUP BY ALL"))
def lca_pairs(spark, d):
    n = fx.nodes(spark, d)
    ids = n.select("node_id")
    pairs = ids.withColumn("one", F.lit(1)).join(ids.agg(F.collect_list("node_id").alias("all")).withColumn("one", F.lit(1)), "one")
    pairs = pairs.select(F.col("node_id").alias("lo"), F.explode("all").alias("hi")).where("lo <= hi")
    return phylo.lca_pairs(pairs, n).select("lo", "hi", "lca")


# ---- reads ----


@query(sql("SELECT sample, read_id, kmer, coalesce(node, 0) AS node FROM hits", hits=True))
def read_lookup_left(spark, d):
    return _hits(spark, d).where("kmer is not null").select("sample", "read_id", "kmer", F.coalesce("node", F.lit(0)).alias("node"))


_RUNS = """WITH o AS (SELECT sample, read_id, node, i, row_number() OVER (PARTITION BY sample, read_id ORDER BY i) - row_number() OVER (PARTITION BY sample, read_id, node ORDER BY i) AS g FROM hits WHERE node IS NOT NULL),
r AS (SELECT sample, read_id, node, g, count(*) AS cnt, min(i) AS first_i FROM o GROUP BY ALL)
"""


@query(sql(_RUNS + "SELECT sample, read_id, CAST(row_number() OVER (PARTITION BY sample, read_id ORDER BY first_i) AS INTEGER) AS run, node, cnt FROM r", hits=True))
def read_hits_rle(spark, d):
    found = classify.run_lengths(_hits(spark, d))
    return found.select("sample", "read_id", F.posexplode("hits").alias("p", "h")).select("sample", "read_id", (F.col("p") + 1).alias("run"), "h.node", "h.cnt")


@query(sql(_RUNS + "SELECT sample, read_id, string_agg('p' || node || ':' || cnt, ' ' ORDER BY first_i) AS hits FROM r GROUP BY ALL", hits=True))
def read_hits_string(spark, d):
    return classify.run_lengths(_hits(spark, d)).select("sample", "read_id", names.hits_text("hits").alias("hits"))


@query(sql("SELECT sample, read_id, code, node, n, m FROM vote", vote="0.1"))
def read_vote(spark, d):
    return _votes(spark, d)


@query(sql("SELECT sample, read_id, code, node, n, m FROM vote", vote="0.0"))
def read_vote_alpha0(spark, d):
    return _votes(spark, d, 0.0)


@query(sql("SELECT sample, read_id, code, node, n, m FROM vote", vote="0.6"))
def read_vote_alpha60(spark, d):
    return _votes(spark, d, 0.6)


@query(sql(_RUNS + ", t AS (SELECT sample, read_id, string_agg('p' || node || ':' || cnt, ' ' ORDER BY first_i) AS hits FROM r GROUP BY ALL) SELECT sample, code, read_id, 'p' || node AS node, CAST(length AS INTEGER) AS length, coalesce(hits, '') AS hits FROM vote LEFT JOIN t USING (sample, read_id)", vote="0.1"))
def read_report(spark, d):
    return classify.raw_rows(classify.classify(fx.reads(spark, d), _table(spark, d), fx.nodes(spark, d), K))


@query(sql("SELECT sample, code, node, count(*) AS n FROM vote GROUP BY ALL", vote="0.1"))
def classify_counts(spark, d):
    return _votes(spark, d).groupBy("sample", "code", "node").agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"SELECT a.sample, a.read_id, a.seq || {fx.RC.format(x='a.seq')} AS seq, CAST(2 * length(a.seq) AS INTEGER) AS length FROM fx_reads a"))
def read_pair_merge(spark, d):
    r = fx.reads(spark, d)
    mate = r.select("sample", "read_id", kmers.reverse_complement("seq").alias("mate"))
    return r.join(mate, ["sample", "read_id"]).select("sample", "read_id", F.concat("seq", "mate").alias("seq")).withColumn("length", F.length("seq"))


_PREFIX = "substr({a}, 1, CAST(list_max(list_filter(range(0, least(length({a}), length({b})) + 1), lambda i: substr({a}, 1, i) = substr({b}, 1, i))) AS INTEGER))"


@query(f"SELECT a.c_custkey, {_PREFIX.format(a='a.c_name', b='b.c_name')} AS prefix FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def common_prefix(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("other"))
    return c.join(after, "c_custkey").select("c_custkey", names.common_prefix(F.col("c_name"), F.col("other")).alias("prefix"))


@query(f"SELECT a, b FROM (SELECT a.n_name AS a, b.n_name AS b, row_number() OVER (PARTITION BY a.n_name ORDER BY length({_PREFIX.format(a='a.n_name', b='b.n_name')}) DESC, b.n_name) AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name) WHERE r = 1")
def pair_best_match(spark, d):
    n = load(spark, d, "nation").select("n_name", "n_regionkey")
    both = n.withColumnRenamed("n_name", "a").join(n.withColumnRenamed("n_name", "b"), "n_regionkey").where("a <> b")
    best = both.groupBy("a").agg(F.min(F.struct((-F.length(names.common_prefix(F.col("a"), F.col("b")))).alias("l"), "b")).alias("x"))
    return best.select("a", F.col("x.b").alias("b"))


# ---- counts and reports ----


@query(sql("SELECT sample, node, sl, ml FROM cnt", vote="0.1"))
def counts_sl_ml(spark, d):
    return _counts(spark, d)


_SAMPLES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(sql("SELECT node, " + ", ".join(f"CAST(coalesce(sum(sl) FILTER (sample = '{s}'), 0) AS BIGINT) AS \"{s}\"" for s in _SAMPLES) + " FROM cnt GROUP BY node", vote="0.1"))
def counts_pivot(spark, d):
    return results.wide(_counts(spark, d), "sl", _SAMPLES)


@query(sql("SELECT s.sample, n.node, CAST(coalesce(c.sl, 0) AS BIGINT) AS sl FROM (SELECT DISTINCT node FROM cnt) n CROSS JOIN (SELECT unnest(" + repr(_SAMPLES) + ") AS sample) s LEFT JOIN cnt c ON c.node = n.node AND c.sample = s.sample", vote="0.1"))
def counts_unpivot(spark, d):
    return results.long(results.wide(_counts(spark, d), "sl", _SAMPLES), "sl").select("sample", "node", "sl")


_ROLL = """WITH up AS (SELECT sample, ancestor AS node, CAST(sum(sl) AS BIGINT) AS sl, CAST(sum(ml) AS BIGINT) AS ml FROM cnt JOIN fx_closure ON descendant = node GROUP BY ALL
  UNION ALL SELECT sample, node, sl, ml FROM cnt WHERE node = 0),
tot AS (SELECT sample, CAST(sum(sl + ml) AS BIGINT) AS total FROM cnt GROUP BY ALL)
"""


@query(sql(_ROLL + "SELECT sample, node, sl, ml FROM up", vote="0.1"))
def rollup_phylo(spark, d):
    return phylo.roll_up(_counts(spark, d), fx.nodes(spark, d), ["sample"], ["sl", "ml"])


_LOW = "CAST(floor(total * 2000.0 / 1e6) AS BIGINT)"


@query(sql(_ROLL + f"SELECT sample, node, CASE WHEN sl + ml < CAST(floor(CAST(sum(sl + ml) OVER (PARTITION BY sample) AS BIGINT) * 20000.0 / 1e6) AS BIGINT) THEN 0 ELSE sl + ml END AS cnt FROM cnt", vote="0.1"))
def cpm_cutoff(spark, d):
    return results.cpm_cutoff(_counts(spark, d).select("sample", "node", (F.col("sl") + F.col("ml")).alias("cnt")), 20_000)


def _percent(x: str) -> str:
    return f"CAST(round({x} * 100.0::DOUBLE / total, 3) AS VARCHAR) || ' %'"


@query(sql(_ROLL + f"SELECT sample, node, {_percent('(sl + ml)')} AS perc FROM up JOIN tot USING (sample)", vote="0.1"))
def percent_summary(spark, d):
    c = _counts(spark, d)
    rolled = phylo.roll_up(c, fx.nodes(spark, d), ["sample"], ["sl", "ml"])
    total = c.groupBy("sample").agg(F.sum(F.col("sl") + F.col("ml")).alias("total"))
    return rolled.join(total, "sample").select("sample", "node", results.percent(F.col("sl") + F.col("ml"), F.col("total")).alias("perc"))


@query(sql(f"""{_ROLL}, own AS (SELECT up.sample, up.node, up.sl AS c_cumul, up.ml AS s_cumul, up.sl + up.ml AS t0, coalesce(c.sl, 0) AS c_count, coalesce(c.ml, 0) AS s_count, total
  FROM up JOIN tot USING (sample) LEFT JOIN cnt c ON c.sample = up.sample AND c.node = up.node),
cut AS (SELECT *, CASE WHEN t0 < {_LOW} THEN 0 ELSE t0 END AS t_cumul FROM own)
SELECT sample, node, {_percent('c_cumul')} AS c_perc, c_cumul, c_count, {_percent('s_cumul')} AS s_perc, s_cumul, s_count, {_percent('t_cumul')} AS t_perc, t_cumul, c_count + s_count AS t_count FROM cut WHERE t_cumul > 0""", vote="0.1"))
def sample_summary(spark, d):
    return results.summarise(_counts(spark, d), fx.nodes(spark, d), 2000.0)


@query(sql("SELECT sample, node, sl, ml FROM cnt WHERE node = 0 OR node IN (SELECT node FROM cnt WHERE sl + ml > 0)", vote="0.1"))
def remove_zeros_joint(spark, d):
    return results.drop_zero_nodes(results.on_all_nodes(_counts(spark, d), fx.nodes(spark, d))).where("sl + ml > 0")


@query(sql("SELECT CASE WHEN sample IN ('AUTOMOBILE', 'MACHINERY') THEN 'AUTOMOBILE' ELSE sample END AS sample, node, CAST(sum(sl) AS BIGINT) AS sl, CAST(sum(ml) AS BIGINT) AS ml FROM cnt GROUP BY ALL", vote="0.1"))
def group_samples(spark, d):
    groups = spark.createDataFrame([("AUTOMOBILE", "vehicles"), ("MACHINERY", "vehicles")], "sample string, `group` string")
    return results.group_samples(_counts(spark, d), groups)


@query(sql("SELECT sample, max(sl + ml) AS most, min(CASE WHEN sl + ml > 0 THEN sl + ml END) AS least FROM cnt GROUP BY ALL", vote="0.1"))
def minmax_nonzero(spark, d):
    return results.min_max(_counts(spark, d).select("sample", (F.col("sl") + F.col("ml")).alias("cnt")))


@query(sql("SELECT sample, node, sl, ml FROM cnt UNION ALL SELECT s.sample, n.node_id, 0, 0 FROM (SELECT node_id FROM fx_nodes UNION ALL SELECT 0) n CROSS JOIN (SELECT DISTINCT sample FROM cnt) s WHERE NOT EXISTS (SELECT 1 FROM cnt c WHERE c.sample = s.sample AND c.node = n.node_id)", vote="0.1"))
def counts_on_all_nodes(spark, d):
    return results.on_all_nodes(_counts(spark, d), fx.nodes(spark, d)).select("sample", "node", "sl", "ml")


# ---- taxonomy ----


@query(sql("SELECT taxid, CASE WHEN parent IS NULL THEN taxid WHEN parent = '1' THEN '1;' || taxid ELSE '1;' || parent || ';' || taxid END AS lineage FROM fx_taxonomy"))
def tax_lineage(spark, d):
    return taxonomy.lineages(fx.taxonomy(spark, d)).select("taxid", F.array_join("lineage", ";").alias("lineage"))


@query(sql("SELECT node_id AS node, taxid FROM fx_taxonomy"))
def tax_common_prefix(spark, d):
    return _clade_taxids(spark, d)


_BY_TAX = "WITH bt AS (SELECT sample, CASE WHEN node = 0 THEN 'unclassified' ELSE taxid END AS taxid, CAST(sum(sl) AS BIGINT) AS sl, CAST(sum(ml) AS BIGINT) AS ml FROM cnt LEFT JOIN fx_taxonomy t ON t.node_id = node GROUP BY ALL)\n"


@query(sql(_BY_TAX + "SELECT sample, taxid, sl, ml FROM bt", vote="0.1"))
def tax_gather(spark, d):
    return taxonomy.by_taxid(_counts(spark, d), _clade_taxids(spark, d))


@query(sql(_BY_TAX + """SELECT sample, taxid, CAST(sum(sl) AS BIGINT) AS sl, CAST(sum(ml) AS BIGINT) AS ml FROM (
  SELECT sample, taxid, sl, ml FROM bt UNION ALL SELECT b.sample, '1', sl, ml FROM bt b WHERE taxid NOT IN ('1', 'unclassified')
  UNION ALL SELECT b.sample, t.parent, sl, ml FROM bt b JOIN fx_taxonomy t USING (taxid) WHERE t.parent <> '1') GROUP BY ALL""", vote="0.1"))
def tax_rollup(spark, d):
    return taxonomy.roll_up(taxonomy.by_taxid(_counts(spark, d), _clade_taxids(spark, d)), taxonomy.lineages(fx.taxonomy(spark, d)))


@query(sql("SELECT sample, code, read_id, CASE WHEN code = 'U' THEN 'NA' ELSE taxid END AS taxid, CAST(length AS INTEGER) AS length FROM vote LEFT JOIN fx_taxonomy t ON t.node_id = node", vote="0.1"))
def tax_raw_convert(spark, d):
    result = classify.classify(fx.reads(spark, d), _table(spark, d), fx.nodes(spark, d), K, with_hits=False)
    return taxonomy.convert_raw(result, _clade_taxids(spark, d))


@query(sql("SELECT taxid, '1' AS \"no rank\", CASE rank WHEN 'superkingdom' THEN taxid WHEN 'species' THEN parent END AS superkingdom, CASE rank WHEN 'species' THEN taxid END AS species FROM fx_taxonomy"))
def tax_rank_pivot(spark, d):
    t = fx.taxonomy(spark, d)
    return taxonomy.rank_table(taxonomy.lineages(t), t, ["no rank", "superkingdom", "species"])


@query(sql("SELECT taxid, CASE rank WHEN 'superkingdom' THEN taxid WHEN 'species' THEN parent END AS ancestor FROM fx_taxonomy"))
def assign_at_rank(spark, d):
    t = fx.taxonomy(spark, d)
    return taxonomy.at_rank(taxonomy.lineages(t), t, "superkingdom")


@query(sql("WITH r AS (SELECT taxid, CASE rank WHEN 'superkingdom' THEN taxid WHEN 'species' THEN CASE WHEN node_id % 2 = 0 THEN parent END END AS superkingdom, CASE rank WHEN 'species' THEN taxid END AS species FROM fx_taxonomy) SELECT taxid, coalesce(superkingdom, species) AS superkingdom, species FROM r"))
def propagate_ranks(spark, d):
    t = fx.taxonomy(spark, d)
    table = taxonomy.rank_table(taxonomy.lineages(t), t, ["superkingdom", "species"])
    gap = F.col("species").isNotNull() & (F.col("species").cast("int") % 2 == 1)
    return taxonomy.fill_up(table.withColumn("superkingdom", F.when(~gap | F.col("species").isNull(), F.col("superkingdom"))), ["superkingdom", "species"])


@query(sql("SELECT t.taxid, coalesce(k.taxid, t.parent) AS nearest FROM fx_taxonomy t LEFT JOIN fx_taxonomy k ON k.taxid = t.taxid AND k.rank <> 'species'"))
def nearest_known_taxid(spark, d):
    t = fx.taxonomy(spark, d)
    return taxonomy.nearest_known(taxonomy.lineages(t), t.where("rank <> 'species'"))


@query(sql("SELECT parent, taxid AS child FROM fx_taxonomy WHERE parent IS NOT NULL"))
def tax_edges(spark, d):
    return taxonomy.edges(taxonomy.lineages(fx.taxonomy(spark, d)))


@query(sql("SELECT taxid, CASE rank WHEN 'no rank' THEN 0 WHEN 'superkingdom' THEN 1 ELSE 2 END AS depth FROM fx_taxonomy"))
def tax_pool(spark, d):
    return taxonomy.pool(taxonomy.lineages(fx.taxonomy(spark, d)))


@query(sql("SELECT node_id AS clade, taxid, name AS taxa, rank FROM fx_taxonomy"))
def tax_clade_table(spark, d):
    return taxonomy.clade_table(_clade_taxids(spark, d), fx.taxonomy(spark, d))


@query(sql("SELECT taxid, name FROM fx_taxonomy WHERE taxid NOT IN (SELECT taxid FROM fx_taxonomy WHERE node_id % 5 = 0)"))
def bad_taxid_anti(spark, d):
    t = fx.taxonomy(spark, d)
    return taxonomy.drop_bad(t.select("taxid", "name"), t.where("taxid <> '1' and (cast(taxid as int) - 1000) % 5 = 0"))


@query(sql("SELECT CASE WHEN rank = 'species' THEN parent ELSE taxid END AS taxid, name FROM fx_taxonomy"))
def taxid_replace(spark, d):
    t = fx.taxonomy(spark, d)
    return taxonomy.replace(t.select("taxid", "name"), t.where("rank = 'species'").select("taxid", F.col("parent").alias("new")))


# ---- sketches and distances ----

_HASH = "CAST(('0x' || substr(md5(kmer), 1, 15)) AS BIGINT)"
_SCALED = f"WITH sk AS (SELECT DISTINCT node_id, {_HASH} AS hash FROM gk WHERE {_HASH} < {(1 << 60) // 4})"


@query(sql(_SCALED + " SELECT node_id, hash FROM sk", kmers=True))
def minhash_scaled(spark, d):
    return phylogeny.sketch_scaled(fx.genomes(spark, d), K, 4)


@query(sql(f"SELECT node_id, hash FROM (SELECT node_id, hash, row_number() OVER (PARTITION BY node_id ORDER BY hash) AS r FROM (SELECT DISTINCT node_id, {_HASH} AS hash FROM gk)) WHERE r <= 50", kmers=True))
def minhash_bottom_s(spark, d):
    return phylogeny.sketch_bottom(fx.genomes(spark, d), K, 50)


_BOTTOM = f"""WITH all_h AS (SELECT DISTINCT node_id, {_HASH} AS hash FROM gk),
bs AS (SELECT * FROM all_h QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY hash) <= 50),
u AS (SELECT x.node_id AS a, y.node_id AS b, h.hash, count(*) AS n FROM (SELECT DISTINCT node_id FROM bs) x JOIN (SELECT DISTINCT node_id FROM bs) y ON x.node_id < y.node_id JOIN bs h ON h.node_id IN (x.node_id, y.node_id) GROUP BY ALL),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY hash) <= 50)
"""


@query(sql(_BOTTOM + "SELECT a, b, CAST(sum(n - 1) AS BIGINT) AS shared, round(sum(n - 1) / count(*), 9) AS jaccard FROM l GROUP BY a, b HAVING (SELECT count(*) FROM u WHERE u.a = l.a AND u.b = l.b AND u.n = 2) > 0", kmers=True))
def mash_bottom_pairs(spark, d):
    """The Jaccard index of bottom sketches: over the 50 least hashes of both together."""
    return phylogeny.pairs_bottom(phylogeny.sketch_bottom(fx.genomes(spark, d), K, 50), K, 50).select("a", "b", "shared", F.round("jaccard", 9).alias("jaccard"))


_PAIRS = _SCALED + """, sz AS (SELECT node_id, count(*) AS n FROM sk GROUP BY ALL), sh AS (SELECT a.node_id AS a, b.node_id AS b, count(*) AS shared FROM sk a JOIN sk b USING (hash) WHERE a.node_id < b.node_id GROUP BY ALL),
pr AS (SELECT a, b, shared, CAST(shared AS DOUBLE) / (x.n + y.n - shared) AS j FROM sh JOIN sz x ON x.node_id = a JOIN sz y ON y.node_id = b),
ds AS (SELECT *, CASE WHEN j >= 1 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ln(2 * j / (1 + j)) * (-1.0::DOUBLE / 15)) END AS distance FROM pr)
"""


@query(sql(_PAIRS + "SELECT a, b, shared, round(j, 9) AS jaccard FROM ds", kmers=True))
def jaccard_pairs(spark, d):
    return phylogeny.pairs(phylogeny.sketch_scaled(fx.genomes(spark, d), K, 4), K).select("a", "b", "shared", F.round("jaccard", 9).alias("jaccard"))


@query(sql(_PAIRS + "SELECT a, b, round(distance, 9) AS distance FROM ds", kmers=True))
def mash_distance(spark, d):
    return phylogeny.pairs(phylogeny.sketch_scaled(fx.genomes(spark, d), K, 4), K).select("a", "b", F.round("distance", 9).alias("distance"))


@query(sql(_PAIRS + """, al AS (SELECT x.node_id AS a, y.node_id AS b, CASE WHEN x.node_id = y.node_id THEN 0.0::DOUBLE ELSE coalesce(p.distance, 1.0::DOUBLE) END AS distance FROM fx_leaves x CROSS JOIN fx_leaves y LEFT JOIN ds p ON p.a = least(x.node_id, y.node_id) AND p.b = greatest(x.node_id, y.node_id))
SELECT a AS node_id, CAST(a AS VARCHAR) || chr(9) || string_agg(printf('%.6f', distance), chr(9) ORDER BY b) AS line FROM al GROUP BY a""", kmers=True))
def phylip_rows(spark, d):
    g = fx.genomes(spark, d)
    return phylogeny.phylip(phylogeny.pairs(phylogeny.sketch_scaled(g, K, 4), K), g)


@query(None)
def neighbour_joining_tree(spark, d):
    """Newick of all genomes; the joining itself is a driver algorithm, tested on additive matrices."""
    return spark.createDataFrame([(phylogeny.build_tree(fx.genomes(spark, d), K),)], "newick string")


# ---- files, written and read back ----


def _put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes a small file wherever Spark can."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(data)
    out.close()
    return path


_LITERAL_READS = [("r1 strain A>B", "ACGT\nAC\n"), ("r2", ""), ("r3\tx > y", "GG\r\nTT\n"), ("r4", "NNA\n")]


@query("SELECT * FROM (VALUES ('one', 1::BIGINT, 'r1', 'ACGTAC'), ('one', 2, 'r2', ''), ('one', 3, 'r3', 'GGTT'), ('one', 4, 'r4', 'NNA')) t(sample, ordinal, read_id, bases)")
def file_fasta_reads(spark, d):
    """Headers that hold > themselves."""
    path = _put(spark, f"{cuts.shared_folder(spark, 'fasta')}/one.fa", "".join(f">{h}\n{b}" for h, b in _LITERAL_READS).encode())
    return sequences.fasta_reads(spark, [path]).select("sample", "ordinal", "read_id", "bases")


@query("SELECT * FROM (VALUES ('two', 1::BIGINT, 'q1 x', 'ACGT'), ('two', 2, 'q2', 'TTTT')) t(sample, ordinal, read_id, bases)")
def file_fastq_reads(spark, d):
    """A quality line that begins with @, in a gzip file."""
    path = _put(spark, f"{cuts.shared_folder(spark, 'fastq')}/two.fq.tar.gz", gzip.compress(b"@q1 x\nACGT\n+\n@@@@\n@q2\nTTTT\n+q2\n!!!!\n"))
    return sequences.reads(spark, [path]).select("sample", "ordinal", "read_id", "bases")


@query("SELECT * FROM (VALUES ('m', 'p/', 'ACNGTN')) t(sample, read_id, seq)")
def file_paired_reads(spark, d):
    folder = cuts.shared_folder(spark, "mates")
    files = [_put(spark, f"{folder}/m_{i}.fa", f">p/{i}\n{bases}\n".encode()) for i, bases in ((1, "AC"), (2, "GT"))]
    ((a, b),) = sequences.mates(files)
    return sequences.paired(sequences.reads(spark, [a]), sequences.reads(spark, [b])).select(F.regexp_replace("sample", "_1$", "").alias("sample"), "read_id", "seq")


@query("SELECT * FROM (VALUES ('g1', 'ACC1', '11', 'ACGTNGG'), ('ref7', 'ACC2', NULL, 'TT')) t(name, accession, taxid, seq)")
def file_genomes(spark, d):
    folder = cuts.shared_folder(spark, "genomes")
    files = [_put(spark, f"{folder}/g1.fna", b">ACC1|kraken:taxid|11| x\nAC\nGT\n>ACC9 y\nGG\n"), _put(spark, f"{folder}/7.fna", b">ACC2 z\nTT\n")]
    return sequences.genomes(spark, files).select("name", "accession", "taxid", "seq")


@query("SELECT * FROM (VALUES ('g1.fna', 0, '11', 'ACGT'), ('g1.fna', 1, 'c2', 'GG')) t(file, ordinal, id, seq)")
def file_contigs(spark, d):
    path = _put(spark, f"{cuts.shared_folder(spark, 'contigs')}/g1.fna", b">gi|11|x\nAC\nGT\n>c2 y\nGG\n")
    return sequences.contigs(spark, [path]).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "ordinal", "id", "seq")


_MATRIX_SQL = """, every AS (SELECT sample, node, sl, ml FROM cnt), live AS (SELECT node FROM every GROUP BY node HAVING max(sl + ml) > 0 OR node = 0)
SELECT e.sample, e.node, CAST(e.{v} AS BIGINT) AS {v} FROM every e JOIN live USING (node) WHERE e.{v} > 0"""


@query(sql("WITH zero AS (SELECT 1)" + _MATRIX_SQL.format(v="sl"), vote="0.1"))
def file_matrix_classified(spark, d):
    return _matrix_back(spark, d, "sl")


@query(sql("WITH zero AS (SELECT 1)" + _MATRIX_SQL.format(v="ml") + " AND e.node <> 0", vote="0.1"))
def file_matrix_split(spark, d):
    """Rows go by labels, and there is no unclassified one."""
    return _matrix_back(spark, d, "ml")


def _matrix_back(spark: SparkSession, d: str, value: str) -> DataFrame:
    path, found, nodes = cuts.shared_folder(spark, value), _counts(spark, d), fx.nodes(spark, d)
    samples = sorted(r["sample"] for r in found.select("sample").distinct().collect())
    reports.write_matrix(found, value, samples, path, nodes=nodes)
    return reports.read_matrix(spark, path, value, nodes).where(F.col(value) > 0).select("sample", "node", value)


@query(sql(_RUNS + "SELECT code = 'C' AS classified, r.node, CAST(sum(cnt) AS BIGINT) AS cnt FROM r JOIN vote v USING (sample, read_id) WHERE code <> 'U' GROUP BY ALL", vote="0.1"))
def file_histograms(spark, d):
    path = cuts.shared_folder(spark, "histograms")
    analytics.save_histograms(node_histogram(spark, d), path)
    return analytics.load_histograms(spark, path)


@query("SELECT * FROM (VALUES ('1', NULL, 'no rank', 'root'), ('2', '1', 'genus', 'A b')) t(taxid, parent, rank, name)")
def file_taxonomy_dump(spark, d):
    folder = cuts.shared_folder(spark, "dump")
    _put(spark, f"{folder}/nodes.dmp", b"1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    _put(spark, f"{folder}/names.dmp", b"1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tA b\t|\t\t|\tscientific name\t|\n2\t|\tab\t|\t\t|\tsynonym\t|\n")
    return reports.read_dump(spark, f"{folder}/nodes.dmp", f"{folder}/names.dmp")


@query(sql(_PAIRS + "SELECT node_id, hash FROM sk", kmers=True))
def file_sketches(spark, d):
    """Stored sketches of half of the genomes, to which the others are added."""
    path, genomes = cuts.shared_folder(spark, "sketches"), fx.genomes(spark, d)
    phylogeny.save_sketches(phylogeny.sketch_scaled(genomes.where("node_id % 2 = 0"), K, 4), path)
    return phylogeny.add_sketches(phylogeny.load_sketches(spark, path), genomes, K, 4).select("node_id", "hash")


@query("SELECT * FROM (VALUES ('a', 'c', 2, 5.0::DOUBLE), ('b', 'd', 1, 3.0)) t(first, last, depth, distance)")
def newick_leaves(spark, d):
    """A tree read from text, written, and read again: first and last leaf below the children of the root, their depth and the way down to them."""
    root = tree.load_newick(tree.write_newick(tree.load_newick("((a:2,c:2):3,(b:1,d:1):2);")))
    rows = [(*(x.name for x in (c.leaves()[0], c.leaves()[-1])), 2 if c.distance == 3 else 1, float(c.distance + c.children[0].distance)) for c in root.children]
    return spark.createDataFrame(rows, "first string, last string, depth int, distance double")


@query(sql("SELECT node_id, list_transform(range(1, 4), lambda i: substr(seq, i * 7 + 1, 15)) AS words FROM fx_genomes"))
def kmer_at_offsets(spark, d):
    return fx.genomes(spark, d).select("node_id", kmers.at_offsets(F.col("seq"), F.array(*[F.lit(7 * i) for i in (1, 2, 3)]), K).alias("words"))


@query("SELECT n_nationkey AS k, replace(n_name, chr(39), '') || ':1' AS text FROM nation")
def newick_clean(spark, d):
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), names.clean_newick(F.concat(F.lit("'"), "n_name", F.lit("'.fna.gz:1"))).alias("text"))


@query("SELECT r AS k, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM (SELECT n_regionkey AS r, 1 AS a, 2 AS b FROM nation UNION ALL SELECT r_regionkey + 3, 5, 7 FROM region) GROUP BY r")
def frames_added(spark, d):
    n = load(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("k"), F.lit(1).alias("a"), F.lit(2).alias("b"))
    r = load(spark, d, "region").select((F.col("r_regionkey") + 3).cast("bigint").alias("k"), F.lit(5).alias("a"), F.lit(7).alias("b"))
    return results.add_frames(n, r, ["k"], ["a", "b"])


# ---- analytics ----


@query(sql(_RUNS + "SELECT code = 'C' AS classified, r.node, CAST(sum(cnt) AS BIGINT) AS cnt FROM r JOIN vote v USING (sample, read_id) WHERE code <> 'U' GROUP BY ALL", vote="0.1"))
def node_histogram(spark, d):
    return analytics.node_histogram(classify.raw_rows(classify.classify(fx.reads(spark, d), _table(spark, d), fx.nodes(spark, d), K)))


# A value stands at the middle of its weight, as a share of all; between values it is interpolated, and outside clamped.
_POINTS = """WITH w AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(sum(l_linenumber) AS DOUBLE) AS w FROM lineitem GROUP BY ALL),
p AS (SELECT x, (sum(w) OVER (ORDER BY x) - w / 2) / sum(w) OVER () AS pl FROM w),
e AS (SELECT q, max({'pl': pl, 'x': x}) FILTER (pl <= q) AS lo, min({'pl': pl, 'x': x}) FILTER (pl >= q) AS hi FROM p CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 0.9, 1.0]) AS q) GROUP BY q),
v AS (SELECT q, coalesce(lo.x + (hi.x - lo.x) * (q - lo.pl) / nullif(hi.pl - lo.pl, 0), lo.x, hi.x) AS value FROM e)
"""


@query(_POINTS + "SELECT q, round(value, 6) AS value FROM v")
def weighted_percentile(spark, d):
    return analytics.weighted_percentiles(load(spark, d, "lineitem"), "l_quantity", "l_linenumber", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]).select("q", F.round("value", 6).alias("value"))


@query(_POINTS + """, u AS (SELECT (max(value) FILTER (q = 0.75) - max(value) FILTER (q = 0.25)) / cbrt((SELECT count(*) FROM w)) AS width FROM v)
SELECT round(width, 6) AS width, CAST(round_even((SELECT max(x) - min(x) FROM w) / width, 0) AS BIGINT) AS bins FROM u""")
def histogram_width(spark, d):
    return analytics.bin_count(load(spark, d, "lineitem"), "l_quantity", "l_linenumber").select(F.round("width", 6).alias("width"), "bins")


@query("SELECT CAST(least(floor((CAST(l_quantity AS DOUBLE) - 0) / 5) + 1, 10) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL")
def histogram_bins(spark, d):
    return analytics.histogram(load(spark, d, "lineitem"), "l_quantity", 0, 50, 10)


@query(sql("SELECT sample, node, round(log2(sl + ml + 1) - avg(log2(sl + ml + 1)) OVER (PARTITION BY sample), 9) AS clr FROM cnt", vote="0.1"))
def clr_transform(spark, d):
    return analytics.log_ratio(_counts(spark, d).select("sample", "node", (F.col("sl") + F.col("ml")).alias("cnt")))


@query(sql("SELECT sample, node, sl + ml AS cnt, round((sl + ml) * 1e6::DOUBLE / sum(sl + ml) OVER (PARTITION BY sample), 6) AS cpm FROM cnt", vote="0.1"))
def counts_per_million(spark, d):
    return analytics.per_million(_counts(spark, d).select("sample", "node", (F.col("sl") + F.col("ml")).alias("cnt")))


@query(sql("""WITH p AS (SELECT v.node, l.node_id AS truth FROM vote v JOIN fx_reads r USING (sample, read_id) JOIN fx_leaves l ON l.nk = r.nk)
SELECT count(*) FILTER (node = truth) AS hits, round(CAST(count(*) FILTER (node = truth) AS DOUBLE) / count(*) FILTER (node > 0), 9) AS "precision", round(CAST(count(*) FILTER (node = truth) AS DOUBLE) / count(*), 9) AS recall FROM p""", vote="0.1"))
def precision_recall(spark, d):
    truth = fx.reads(spark, d).select("sample", "read_id", "nk").join(F.broadcast(fx.leaves(spark, d).select("nk", F.col("node_id").alias("truth"))), "nk")
    p = _votes(spark, d).join(truth, ["sample", "read_id"])
    hit, said = F.sum((F.col("node") == F.col("truth")).cast("bigint")), F.sum((F.col("node") > 0).cast("bigint"))
    return p.agg(hit.alias("hits"), F.round(hit / said, 9).alias("precision"), F.round(hit / F.count(F.lit(1)), 9).alias("recall"))


@query("SELECT k AS nation, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT coalesce(x.k, y.k) AS k, a, b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) x FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY ALL) y ON x.k = y.k)")
def batch_merge_full_outer(spark, d):
    a = load(spark, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("a"))
    b = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("b"))
    return analytics.merge_batches(a, b, "nation")


@query("""WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT o_custkey, o_orderkey, n, size AS s, 0 AS batch FROM r WHERE n = 1 UNION ALL
  SELECT r.o_custkey, r.o_orderkey, r.n, CASE WHEN f.s > 0 AND f.s + r.size > 400000 THEN r.size ELSE f.s + r.size END, f.batch + CASE WHEN f.s > 0 AND f.s + r.size > 400000 THEN 1 ELSE 0 END
  FROM f JOIN r ON r.o_custkey = f.o_custkey AND r.n = f.n + 1)
SELECT o_custkey, o_orderkey, batch FROM f""")
def greedy_batches(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("bigint").alias("size"))
    return analytics.greedy_batches(o, "o_custkey", "o_orderkey", "size", 400_000)


_LOG = "strftime(ts, '%m/%d/%Y %I:%M:%S %p') || '... ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' took ' || (event_id % 97) || '.5 s.' ELSE ' (RSS: ' || (event_id % 31) || '.25Gb, VSZ: ' || (event_id % 53) || '.75Gb)' END"


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    i = F.col("event_id")
    tail = F.when(i % 2 == 0, F.concat(F.lit(" took "), (i % 97).cast("string"), F.lit(".5 s."))).otherwise(F.concat(F.lit(" (RSS: "), (i % 31).cast("string"), F.lit(".25Gb, VSZ: "), (i % 53).cast("string"), F.lit(".75Gb)")))
    return e.select("event_id", F.col("event_type").alias("job"), (F.col("user_id") % 7).alias("pid"), F.concat(F.date_format("ts", "MM/dd/yyyy hh:mm:ss a"), F.lit("... "), "event_type", tail).alias("line"))


@query(f"""WITH l AS (SELECT event_id, ts, {_LOG} AS line FROM events)
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS at, CASE WHEN event_id % 2 = 0 THEN CAST((event_id % 97) || '.5' AS DOUBLE) END AS took, CASE WHEN event_id % 2 = 1 THEN CAST((event_id % 31) || '.25' AS DOUBLE) END AS rss, CASE WHEN event_id % 2 = 1 THEN CAST((event_id % 53) || '.75' AS DOUBLE) END AS vsz FROM l""")
def log_parse(spark, d):
    return analytics.read_log(_log(spark, d)).select("event_id", F.unix_timestamp("at").alias("at"), "took", "rss", "vsz")


@query("""WITH l AS (SELECT event_type AS job, user_id % 7 AS pid, event_id, (event_id % 31) + 0.25::DOUBLE AS rss, (event_id % 53) + 0.75::DOUBLE AS vsz FROM events WHERE event_id % 2 = 1),
t AS (SELECT job, pid, max_by(rss, event_id) AS rss, max_by(vsz, event_id) AS vsz FROM l GROUP BY ALL) SELECT job, round(sum(rss), 6) AS rss, round(sum(vsz), 6) AS vsz FROM t GROUP BY job""")
def job_memory(spark, d):
    log = analytics.read_log(_log(spark, d)).where("rss is not null").withColumn("at", F.col("event_id"))
    return analytics.job_memory(log)


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g, event_id FROM events),
r AS (SELECT user_id, event_type, g, count(*) AS n, min(event_id) AS first_i FROM o GROUP BY ALL) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first_i) AS run, event_type, n FROM r""")
def event_runs(spark, d):
    return analytics.runs(load(spark, d, "events"), "user_id", ["event_id"], "event_type").select("user_id", F.col("run").cast("bigint").alias("run"), "event_type", "n")


@query("SELECT event_id, max(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS \"any\" FROM events")
def sliding_any(spark, d):
    return analytics.any_in_window(load(spark, d, "events"), "user_id", "event_id", F.col("value") > 90, 4).select("event_id", "any")


@query("SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS DOUBLE) AS upto FROM lineitem")
def cumulative_weights(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).cast("double").alias("upto"))


@query(sql(f"""WITH g AS (SELECT node_id, seq, unnest(range(0, 40)) AS i FROM fx_genomes),
s AS (SELECT node_id, i, substr(seq, CAST(CAST('0x' || substr(md5('read-' || node_id || '-' || i), 1, 12) AS BIGINT) % (length(seq) - 60 + 1) AS INTEGER) + 1, 60) AS s FROM g),
e AS (SELECT node_id, i, CASE WHEN i % 5 = 0 THEN substr(s, 1, CAST(i % 60 AS INTEGER)) || translate(substr(s, CAST(i % 60 + 1 AS INTEGER), 1), 'ACGT', 'TGCA') || substr(s, CAST(i % 60 + 2 AS INTEGER), 60) ELSE s END AS seq FROM s)
SELECT node_id, CAST(i AS INTEGER) AS i, seq, {fx.RC.format(x='seq')} AS mate FROM e"""))
def read_simulate_deterministic(spark, d):
    return analytics.simulate_reads(fx.genomes(spark, d), 40, 60, 5)


# ---- names and colours ----

_PATHS = "(SELECT s_suppkey, '/data/' || CASE s_suppkey % 4 WHEN 0 THEN '' ELSE 'GCF_' END || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.fna' WHEN 1 THEN '.faa.gz' ELSE '.fq.tar.gz' END AS path FROM supplier)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    path = F.concat(F.lit("/data/"), F.when(s % 4 == 0, "").otherwise("GCF_"), s.cast("string"), F.when(s % 3 == 0, ".fna").when(s % 3 == 1, ".faa.gz").otherwise(".fq.tar.gz"))
    return load(spark, d, "supplier").select("s_suppkey", path.alias("path"))


@query(f"WITH n AS (SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '(\\.tar)?\\.gz$', ''), '\\.(fna|faa)', '') AS n FROM {_PATHS}) SELECT s_suppkey, CASE WHEN regexp_matches(n, '^\\d+$') THEN 'ref' || n ELSE n END AS name FROM n")
def format_name(spark, d):
    return _paths(spark, d).select("s_suppkey", names.format_name("path", True).alias("name"))


@query(f"SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '(\\.tar)?\\.gz$', ''), '\\.(fasta|fastq|fna|fa|fq)$', '') AS sample, CASE WHEN s_suppkey % 3 = 0 THEN 'fasta' WHEN s_suppkey % 3 = 2 THEN 'fastq' END AS format FROM {_PATHS}")
def sample_name(spark, d):
    return _paths(spark, d).select("s_suppkey", names.sample_name("path").alias("sample"), names.file_format("path").alias("format"))


@query(sql("SELECT node_id, CASE WHEN type = 'Branch' THEN 'p' || name ELSE name END AS label, regexp_replace('p' || node_id, '^p(\\d+)$', '\\1') AS number FROM fx_nodes"))
def node_label(spark, d):
    return fx.nodes(spark, d).select("node_id", names.node_label(F.col("name"), F.col("type")).alias("label"), names.node_number(F.concat(F.lit("p"), F.col("node_id").cast("string"))).alias("number"))


@query("SELECT p_partkey, 'NC_' || p_partkey || '.1' AS accession, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS taxid, 'NC_' || p_partkey AS legacy FROM part")
def accession_parse(spark, d):
    p = F.col("p_partkey")
    header = F.concat(F.lit(">NC_"), p.cast("string"), F.lit(".1"), F.when(p % 2 == 0, F.concat(F.lit("|kraken:taxid|"), p.cast("string"), F.lit("|"))).otherwise(" complete genome"))
    return load(spark, d, "part").select("p_partkey", names.accession(header).alias("accession"), names.header_taxid(header).alias("taxid"), names.legacy_id(header).alias("legacy"))


_RGB = "lpad(to_hex(CAST((s_suppkey * 7919) % 16777216 AS BIGINT)), 6, '0')"
_CH = "CAST('0x' || substr({c}, {i}, 2) AS INTEGER)"


def _hex2(x: str) -> str:
    return f"lpad(to_hex(CAST({x} AS BIGINT)), 2, '0')"


def _mix_sql(a: str, b: str) -> str:
    return " || ".join(_hex2(f"floor(({_CH.format(c=a, i=i)} + {_CH.format(c=b, i=i)}) / 2)") for i in (1, 3, 5))


def _opaque_sql(c: str, q: str) -> str:
    return " || ".join(_hex2(f"floor(255 - {q} * (255 - {_CH.format(c=c, i=i)}))") for i in (1, 3, 5))


def _coloured(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").select("s_suppkey", F.lpad(F.hex((F.col("s_suppkey") * 7919) % 16777216), 6, "0").alias("c"))
    return s.withColumn("q", (F.col("s_suppkey") % 8) / 8.0)


@query(f"SELECT s_suppkey, {_mix_sql('c', chr(39) + '80FF01' + chr(39))} AS colour FROM (SELECT s_suppkey, {_RGB} AS c FROM supplier)")
def colour_mix(spark, d):
    return _coloured(spark, d).select("s_suppkey", colours.mix(F.col("c"), F.lit("80FF01")).alias("colour"))


@query(f"SELECT s_suppkey, {_opaque_sql('c', 'q')} AS colour FROM (SELECT s_suppkey, {_RGB} AS c, (s_suppkey % 8) / 8.0::DOUBLE AS q FROM supplier)")
def colour_opacity_linear(spark, d):
    return _coloured(spark, d).select("s_suppkey", colours.opaque(F.col("c"), F.col("q")).alias("colour"))


@query("SELECT s_suppkey, round(ln((s_suppkey % 9 + 1) / 1.0::DOUBLE) / ln(9 / 1.0::DOUBLE), 9) AS q FROM supplier")
def colour_opacity_log(spark, d):
    score = (F.col("s_suppkey") % 9 + 1).cast("double")
    return load(spark, d, "supplier").select("s_suppkey", F.round(colours.opacity(score, F.lit(1.0), F.lit(9.0), log=True), 9).alias("q"))


@query(f"SELECT 'S' || s_suppkey || chr(9) || 'range' || chr(9) || '#' || c || chr(9) || 'NODE' AS value FROM (SELECT s_suppkey, {_RGB} AS c FROM supplier)")
def itol_rows(spark, d):
    from cladeforge.sources import reports

    return reports.drawing_rows(_coloured(spark, d).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("label"), F.col("c").alias("colour")))


@query(sql("""WITH s AS (SELECT sample, node, sl + ml AS c FROM cnt WHERE node > 0), x AS (SELECT sample, max(c) AS most FROM s GROUP BY ALL),
q AS (SELECT node, sample, CAST(c AS DOUBLE) / most AS q, CASE sample WHEN 'AUTOMOBILE' THEN 'FF0000' ELSE '0000FF' END AS colour FROM s JOIN x USING (sample) WHERE sample IN ('AUTOMOBILE', 'BUILDING') AND c > 0)
SELECT node, count(*) AS n, round(sum(q), 9) AS q FROM q GROUP BY node""", vote="0.1"))
def colour_scores(spark, d):
    c = _counts(spark, d).select("sample", "node", (F.col("sl") + F.col("ml")).alias("cnt")).where("node > 0")
    scored = c.join(results.min_max(c), "sample").where("sample in ('AUTOMOBILE', 'BUILDING') and cnt > 0")
    return scored.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(colours.opacity(F.col("cnt").cast("double"), F.col("least"), F.col("most"))), 9).alias("q"))


@query(sql(f"""WITH s AS (SELECT sample, node, CAST(sl + ml AS DOUBLE) AS c FROM cnt WHERE node > 0), x AS (SELECT sample, max(c) AS most FROM s GROUP BY ALL),
q AS (SELECT node, sample, c / most AS q, CASE sample WHEN 'AUTOMOBILE' THEN 'FF0000' ELSE '0040FF' END AS c FROM s JOIN x USING (sample) WHERE sample IN ('AUTOMOBILE', 'BUILDING')),
o AS (SELECT node, sample, {_opaque_sql('c', 'q')} AS c FROM q),
w AS (SELECT node, max(CASE sample WHEN 'AUTOMOBILE' THEN c END) AS a, max(CASE sample WHEN 'BUILDING' THEN c END) AS b FROM o GROUP BY node),
m AS (SELECT node, b, CASE WHEN a IS NULL THEN 'FFFFFF' ELSE {_mix_sql("'FFFFFF'", 'a')} END AS one FROM w)
SELECT node, CASE WHEN b IS NULL THEN one ELSE {_mix_sql('one', 'b')} END AS colour FROM m""", vote="0.1"))
def draw_colours(spark, d):
    c = _counts(spark, d).select("sample", "node", (F.col("sl") + F.col("ml")).alias("cnt")).where("node > 0")
    return drawing.colour_table(c, {"AUTOMOBILE": "#FF0000", "BUILDING": "#0040FF"})
