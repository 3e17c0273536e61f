"""Trees, k-mers, the vote, roll-up, taxonomy, sources, sketches and streaming."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeforge.functions import colours, kmers, names
from cladeforge.operators import analytics, build, classify, phylo, phylogeny, results, taxonomy, tree
from cladeforge.sources import config, reports, sequences
from cladeforge.streaming import reads as stream

POLY = "(B:6.0,(A:5.0,C:3.0,E:4.0):5.0,D:11.0);"


def test_polytomies():
    root = tree.load_newick(POLY)
    rows = {r[1]: r for r in tree.rows_of(root)}
    assert len(rows) == 9 and sorted(n.name for n in root.leaves()) == list("ABCDE")
    assert all(len(n.children) in (0, 2) for n in root.preorder())
    assert rows["1"][7] == 9


def test_newick_round_trip():
    text = "((A:1.0,B:2.5)1:0.5,('odd name':3.0,C:1.0)2:1.0)root;"
    assert tree.write_newick(tree.parse_newick(text)) == text
    for bad in ("((A,B)", "A,B;", "A)B;"):
        with pytest.raises(ValueError):
            tree.parse_newick(bad)


def test_reduce():
    root = tree.parse_newick("(B:1.0,(D:1.0,(F:1.0,G:1.0)E:1.0)C:1.0)A;")
    small = tree.reduce_tree(root, {"C", "G", "A"})
    assert small.name == "A" and {n.name for n in small.preorder()} >= {"A", "C", "G"}
    merged = tree.reduce_tree(tree.parse_newick("(B:1.0,(D:1.0,(F:1.0,G:1.0)E:1.0)C:1.0)A;"), {"B", "G"})
    assert {n.name: n.distance for n in merged.leaves()} == {"B": 1.0, "G": 3.0}


def test_balanced_and_edits():
    root = tree.balanced(list("abcde"))
    assert sorted(n.name for n in root.leaves()) == list("abcde") and tree.write_newick(root).count(";") == 1
    root = tree.insert_above(root, "c", tree.Node("new", 1.0), "x")
    assert "new" in {n.name for n in root.leaves()}
    assert sorted(n.name for n in tree.remove(root, "new").leaves()) == list("abcde")
    assert tree.splice("({{one}}:1,{{two}}:2);", {"one": "(a,b);", "two": "(c,d);"}) == "((a,b):1,(c,d):2);"


def random_tree(rng, n):
    level = [tree.Node(f"L{i}", 1.0) for i in range(n)]
    while len(level) > 1:
        a, b = level.pop(rng.randrange(len(level))), level.pop(rng.randrange(len(level)))
        level.append(tree.Node(None, 1.0, [a, b]))
    return tree.number_branches(level[0])


def plain_vote(rows, hits, n, alpha):
    """One node after another by descending id: an ancestor's count goes to the first terminal below it."""
    end = {r[0]: r[7] for r in rows}
    m = sum(hits.values())
    if not m:
        return "U", 0
    terminals = {}
    for node in sorted(hits, reverse=True):
        for t in terminals:
            if node <= t <= end[node]:
                terminals[t] += hits[node]
                break
        else:
            terminals[node] = hits[node]
    need = int(np.ceil(np.float32(alpha) * np.float32(n)))
    found = [t for t, c in terminals.items() if c >= need]
    if not found:
        return "S", 1
    lca = max(x for x in end if x <= min(found) and max(found) <= end[x])
    return ("S" if m < n or len(found) > 1 else "C"), lca


def test_vote_against_sequential_rule(spark):
    rng = random.Random(4)
    root = random_tree(rng, 12)
    rows = tree.rows_of(root)
    want, found = {}, []
    for i in range(300):
        own = [rng.choice(rows)[0] if rng.random() < 0.85 else None for _ in range(rng.randrange(0, 12))]
        found += [("s", f"R{i}", j, "k", x) for j, x in enumerate(own)] or [("s", f"R{i}", None, None, None)]
        hits = {x: own.count(x) for x in own if x}
        want[f"R{i}"] = plain_vote(rows, hits, len(own), 0.3) if own else ("U", 0)
    hits = spark.createDataFrame(found, "sample string, read_id string, ordinal int, kmer string, node int")
    got = classify.vote(hits, tree.nodes_frame(spark, root), 0.3)
    assert {r["read_id"]: (r["code"], r["node"]) for r in got.collect()} == want


def test_lca_forms_agree(spark):
    root = random_tree(random.Random(6), 15)
    nodes = tree.nodes_frame(spark, root)
    rows = tree.rows_of(root)
    pairs = [(a[0], b[0], a[1], b[1]) for a in rows for b in rows if a[0] <= b[0]]
    got = phylo.lca_pairs(spark.createDataFrame(pairs, "lo int, hi int, a string, b string"), nodes).collect()
    by_id = {r[0]: r[1] for r in rows}
    assert all(by_id[r["lca"]] == tree.lca_of(root, [r["a"], r["b"]]) for r in got)


def test_paths_from_parents(spark):
    nodes = tree.nodes_frame(spark, random_tree(random.Random(7), 9))
    again = phylo.with_paths(nodes.drop("path"))
    assert {r["node_id"]: r["path"] for r in again.collect()} == {r["node_id"]: r["path"] for r in nodes.collect()}


def test_kmer_twins(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTN" if i % 2 else "ACGTACGTACGTn") for _ in range(rng.randrange(0, 300))) for i in range(20)] + ["", "ACG", "A" * 40]
    df = spark.createDataFrame(list(enumerate(seqs)), "node_id int, seq string")
    for k in (1, 5, 31):
        a = kmers.explode_windows(df, ["node_id"], k).select("node_id", kmers.encode("kmer").alias("code")).groupBy("node_id", "code").count()
        b = kmers.explode_codes(df, ["node_id"], k).groupBy("node_id", "code").count()
        c = kmers.explode_offsets(df, ["node_id"], k, stretch=7).select("node_id", kmers.encode(kmers.canonical("word")).alias("code")).groupBy("node_id", "code").count()
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == sorted(map(tuple, c.collect()))
    one = spark.range(1).select(kmers.canonical(F.lit("TTTACG")).alias("a"), kmers.canonical(kmers.reverse_complement(F.lit("TTTACG"))).alias("b"), kmers.decode(kmers.encode(F.lit("ACGTT")), 5).alias("c")).first()
    assert one["a"] == one["b"] and one["c"] == "ACGTT"


def test_all_words(spark):
    import itertools

    seq = "N".join("".join(w) for w in itertools.product("ACGT", repeat=6))
    found = kmers.explode_windows(spark.createDataFrame([(1, seq)], "node_id int, seq string"), ["node_id"], 6)
    assert found.count() == 4096 and found.select("kmer").distinct().count() == 2080


def test_key_ranges():
    ranges = build.key_ranges(15, 31)
    assert ranges[0][1] == 0 and ranges[-1][2] == 4**31 and all(a[2] == b[1] for a, b in zip(ranges, ranges[1:], strict=False))


def test_roll_up_golden(spark):
    root = tree.load_newick("((a:1,b:1):1,c:1);")
    nodes = tree.nodes_frame(spark, root)
    leaf = next(r[0] for r in tree.rows_of(root) if r[1] == "a")
    counts = spark.createDataFrame([("x", 1, 3, 0), ("x", 2, 232, 0), ("x", leaf, 765, 0)], "sample string, node int, sl bigint, ml bigint")
    got = {r["node"]: (r["t_cumul"], r["t_perc"]) for r in results.summarise(counts, nodes, 100).collect()}
    assert got == {1: (1000, "100.0 %"), 2: (997, "99.7 %"), leaf: (765, "76.5 %")}


def test_cutoff_and_matrices(spark, tmp_path):
    root = tree.load_newick("((a:1,b:1):1,c:1);")
    nodes = tree.nodes_frame(spark, root)
    counts = spark.createDataFrame([("x", 1, 990, 0), ("x", 3, 10, 0), ("y", 0, 5, 0), ("y", 4, 0, 2)], "sample string, node int, sl bigint, ml bigint")
    assert {r["node"] for r in results.summarise(counts.where("sample = 'x'"), nodes, 11_000).collect()} == {1}
    reports.write_matrix(counts, "sl", ["x", "y"], str(tmp_path / "m"), keep_zeros=True)
    back = reports.read_matrix(spark, str(tmp_path / "m"), "sl", nodes).where("sl > 0")
    assert sorted(map(tuple, back.select("sample", "node", "sl").collect())) == [("x", 1, 990), ("x", 3, 10), ("y", 0, 5)]


def test_common_prefix_of_lineages(spark):
    root = tree.load_newick("((a:1,b:1):1,c:1);")
    nodes = tree.nodes_frame(spark, root)
    ids = {r[1]: r[0] for r in tree.rows_of(root)}
    lines = spark.createDataFrame([(ids["a"], ["1", "2", "9", "5"]), (ids["b"], ["1", "2", "8", "5"]), (ids["c"], ["1", "3"])], "leaf int, lineage array<string>")
    got = dict(map(tuple, taxonomy.common_prefixes(nodes, lines).collect()))
    assert got == {ids["a"]: "5", ids["b"]: "5", ids["c"]: "3", 2: "2", 1: "1"}


def test_files(spark, tmp_path):
    (tmp_path / "g.fna").write_text(">ACC1.2|kraken:taxid|77| x\nACGT\nacgt\n>second\nTTTT\n")
    g = sequences.genomes(spark, [str(tmp_path / "g.fna")]).first()
    assert (g["name"], g["accession"], g["taxid"], g["seq"]) == ("g", "ACC1.2", "77", "ACGTacgtNTTTT")
    with gzip.open(tmp_path / "s_1.fa.gz", "wt") as f:
        f.write(">R1/1 a\nAC\nGT\n>R2/1\nTTTT\n")
    (tmp_path / "s_2.fa").write_text(">R1/2 a\nGGGG\n>R2/2\nCCCC\n")
    files = sequences.list_files(str(tmp_path), None)
    pairs = sequences.mates([f for f in files if "s_" in f])
    both = sequences.paired(sequences.reads(spark, [pairs[0][0]]), sequences.reads(spark, [pairs[0][1]]))
    assert sorted(map(tuple, both.collect())) == [("s_1", "R1/", "ACGTNGGGGN"), ("s_1", "R2/", "TTTTNCCCCN")]
    (tmp_path / "q.fastq").write_text("@id one\nACGT\n+\n@@@@\n@id two\nGGTT\n+\n!!!!\n")
    assert sorted(map(tuple, sequences.single(sequences.reads(spark, [str(tmp_path / "q.fastq")])).collect())) == [("q", "id one", "ACGTN"), ("q", "id two", "GGTTN")]
    rng = random.Random(8)
    many = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(30))) for i in range(3000)]
    (tmp_path / "m_1.fastq").write_text("".join(f"@{n}/1\n{s}\n+\n{'@' * 30}\n" for n, s in many))
    (tmp_path / "m_2.fa").write_text("".join(f">{n}/2\n{s[:20]}\n{s[20:]}\n" for n, s in many))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # many blocks a file
    try:
        got = sequences.paired(sequences.reads(spark, [str(tmp_path / "m_1.fastq")]), sequences.reads(spark, [str(tmp_path / "m_2.fa")])).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert {(r["read_id"], r["seq"]) for r in got} == {(f"{n}/", f"{s}N{s}N") for n, s in many} and len(got) == 3000
    for bad in ("x.txt", "x.tar", "x.fa.tar"):
        with pytest.raises(ValueError):
            names.format_of(bad)
    with pytest.raises(ValueError):
        sequences.mates(["a.fa", "b.fa", "c.fa"])
    (tmp_path / "bad.fna").write_text("ACGT\n")
    with pytest.raises(Exception, match="no header"):
        sequences.genomes(spark, [str(tmp_path / "bad.fna")]).collect()


def test_dump(spark, tmp_path):
    (tmp_path / "nodes").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n9\t|\t2\t|\tspecies\t|\n")
    (tmp_path / "names").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tBac\t|\t\t|\tsynonym\t|\n2\t|\tBacteria\t|\t\t|\tscientific name\t|\n9\t|\tX y\t|\t\t|\tscientific name\t|\n")
    t = reports.read_dump(spark, str(tmp_path / "nodes"), str(tmp_path / "names"))
    assert {r["taxid"]: r["lineage"] for r in taxonomy.lineages(t).collect()} == {"1": ["1"], "2": ["1", "2"], "9": ["1", "2", "9"]}


def test_config(tmp_path):
    c = config.Config()
    c.set(k=31, s=1000)
    c.add_sequences(["/d/a.fna", "/d/b.fna"])
    c.add_sequences(["/d/c.fna"], "other")
    c.group_set("other", k=21)
    with pytest.raises(ValueError):
        c.add_sequences(["/d/a.fna"], "other")
    c.save(str(tmp_path / "c.json"))
    again = config.Config.load(str(tmp_path / "c.json"))
    assert again == c and again.group_get("other") == (21, 1000, ["/d/c.fna"]) and again.group_get("default")[0] == 31
    assert json.loads((tmp_path / "c.json").read_text())["groups"]["other"]["k"] == 21


def test_neighbour_joining_of_an_additive_matrix():
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    root = phylogeny.neighbour_joining(d, list("abcde"))
    up, depth = {}, {id(root): 0.0}
    for n in root.preorder():
        for c in n.children:
            up[id(c)], depth[id(c)] = n, depth[id(n)] + c.distance
    leaves = {n.name: n for n in root.leaves()}

    def path(n):
        out = [id(n)]
        while id(n) in up:
            n = up[id(n)]
            out.append(id(n))
        return out

    for i, a in enumerate("abcde"):
        for j, b in enumerate("abcde"):
            shared = next(x for x in path(leaves[a]) if x in path(leaves[b]))
            assert abs(depth[id(leaves[a])] + depth[id(leaves[b])] - 2 * depth[shared] - d[i, j]) < 1e-9


def test_colours(spark):
    r = spark.range(1).select(colours.mix(F.lit("FFFFFF"), F.lit("000000")).alias("a"), colours.opaque(F.lit("FF0000"), F.lit(0.5)).alias("b"), colours.opacity(F.lit(3.0), F.lit(3.0), F.lit(3.0), log=True).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ("7F7F7F", "FF7F7F", 1.0)


def test_greedy_batches(spark):
    sizes = [30, 30, 50, 120, 10, 90, 1]
    got = analytics.greedy_batches(spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i int, s int"), "g", "i", "s", 100)
    assert [r["batch"] for r in got.orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 4]


def test_stream_equals_batch(spark, tmp_path):
    from cladeforge.plans import fixtures as fx

    d = "/root/testdata/sf0.001"
    nodes, table = fx.nodes(spark, d), build.kmer_table(fx.genomes(spark, d), fx.nodes(spark, d), fx.K)
    build.save_table(table, str(tmp_path / "db"), 2)
    table = build.load_table(spark, str(tmp_path / "db"))
    reads = fx.reads(spark, d).select("sample", "read_id", "seq")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.classify_stream(stream.read_stream(spark, str(tmp_path / "in"), 1), table, nodes, fx.K, stream.counts_sink(str(tmp_path / "out")), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = results.counts(classify.classify(reads, table, nodes, fx.K, with_hits=False))
    columns = ["sample", "node", "sl", "ml"]
    assert sorted(map(tuple, stream.read_counts(spark, str(tmp_path / "out")).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70


def test_lineages_of_any_depth_and_cycles(spark):
    from cladeforge.operators import taxonomy

    chain = [(str(i), str(i - 1) if i else None) for i in range(70)]
    got = {r["taxid"]: len(r["lineage"]) for r in taxonomy.lineages(spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("z", "lost")], "taxid string, parent string").coalesce(1)).collect()}
    assert got == {str(i): i + 1 for i in range(70)}


def test_long_sequences_are_cut_without_loss(spark):
    import random

    from cladeforge.functions import kmers

    rng = random.Random(3)
    seq = "".join(rng.choice("ACGTN" if i % 50 == 0 else "ACGT") for i in range(5000))
    rows = spark.createDataFrame([(1, seq), (2, "ACG"), (3, None), (4, seq[:15])], "id int, seq string")
    whole = kmers.explode_windows(rows, ["id"], 15).select("id", "kmer").collect()
    cut = kmers.stretches(rows, ["id"], 15, stretch=64).select("id", F.explode(kmers.windows("_seq", 15)).alias("w")).select("id", kmers.canonical("w").alias("kmer")).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and len(whole) > 4000


def test_headers_with_the_record_sign(spark, tmp_path):
    from cladeforge.sources import sequences

    (tmp_path / "a.fa").write_text(">r1 strain A>B\nACGT\n>r2 >\nGG\n")
    (tmp_path / "b.fa").write_text("no record yet\n>r3\nTT\n")
    got = sorted((r["sample"], r["ordinal"], r["read_id"], r["bases"]) for r in sequences.fasta_reads(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")]).collect())
    assert got == [("a", 1, "r1", "ACGT"), ("a", 2, "r2", "GG"), ("b", 1, "r3", "TT")]


def test_matrices_of_other_samples_raise(spark):
    from cladeforge.operators import results

    with pytest.raises(ValueError):
        results.checked(spark.createDataFrame([(1, 2)], "node int, a int"), spark.createDataFrame([(1, 2)], "node int, b int"))
