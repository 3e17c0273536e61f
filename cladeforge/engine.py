"""A database of sequences and what is done with it: the engine behind the command line.

Folders may be on any file system that Spark reads for tables; the configuration and the tree are small local files of the driver.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.operators import analytics, build, classify, drawing, phylo, phylogeny, results, taxonomy, tree
from cladeforge.sources import reports, sequences
from cladeforge.sources.config import Config, DatabaseFolders, ResultFolders


class Database:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.folders = spark, DatabaseFolders(root)
        self.config = Config.load(self.folders.config) if os.path.exists(self.folders.config) else Config(name=os.path.basename(root))

    def create(self) -> Database:
        self.folders.create()
        self.save()
        return self

    def check(self) -> Database:
        """Raises if the folder is no database."""
        if lost := self.folders.missing():
            raise ValueError(f"no database at {self.folders.root}: {', '.join(lost)} is missing")
        return self

    def save(self) -> None:
        self.config.save(self.folders.config)

    def add(self, folder: str, group: str = "default", first: int | None = None) -> list[str]:
        files = sequences.list_files(folder)[:first] if os.path.isdir(folder) else [os.path.realpath(folder)]
        self.config.add_sequences(files, group)
        self.save()
        return files

    def remove(self, files: list[str] | None = None, group: str | None = None) -> None:
        if files is None and group is not None:
            self.config.remove_group(group)
        else:
            self.config.remove_sequences(files or [], group)
        self.save()

    def set(self, group: str | None = None, **values) -> None:
        self.config.group_set(group, **values) if group else self.config.set(**values)
        self.save()

    # ---- trees ----

    def genomes(self, group: str | None = None) -> DataFrame:
        return sequences.genomes(self.spark, self.config.group_get(group)[2] if group else self.config.paths())

    def _stage(self, kind: str, group: str | None, scaled: int | None, bottom: bool) -> tuple[str, int, int]:
        """(folder of a stage, k, sketch size); stages of other parameters lie beside each other."""
        k, s, _ = self.config.group_get(group or "default")
        if k is None or (scaled or s) is None:
            raise ValueError("k and a sketch size must be set")
        return f"{self.folders.phylogeny}/{kind}/{group or 'default'}.k{k}.s{scaled or s}.{'bottom' if bottom else 'scaled'}", k, scaled or s

    def sketch(self, group: str | None = None, scaled: int | None = None, bottom: bool = False) -> DataFrame:
        """Sketches of all genomes, scaled or bottom ones. Those that are stored already are not made again."""
        path, k, s = self._stage("sketch", group, scaled, bottom)
        genomes = self.genomes(group)
        if not os.path.exists(path):
            phylogeny.save_sketches((phylogeny.sketch_bottom if bottom else phylogeny.sketch_scaled)(genomes, k, s, "name"), path)
        elif not bottom:
            missing = genomes.join(phylogeny.load_sketches(self.spark, path).select("name").distinct(), "name", "left_anti")
            if not missing.isEmpty():
                phylogeny.sketch_scaled(missing, k, s, "name").write.mode("append").parquet(path)
        return phylogeny.load_sketches(self.spark, path)

    def distance(self, group: str | None = None, scaled: int | None = None, bottom: bool = False) -> DataFrame:
        """Distances of all pairs of sketches, with the matrix as a text file beside them. What is there is kept."""
        path, k, s = self._stage("distance", group, scaled, bottom)
        if not os.path.exists(path):
            sketch = self.sketch(group, scaled, bottom)
            (phylogeny.pairs_bottom(sketch, k, s, "name") if bottom else phylogeny.pairs(sketch, k, "name")).write.parquet(path)
            known = self.genomes(group).select("name").distinct()
            reports.write_phylip(phylogeny.phylip(self.spark.read.parquet(path), known, "name"), known.count(), path + ".tab")
        return self.spark.read.parquet(path)

    def neighbour_joining(self, group: str | None = None, scaled: int | None = None, bottom: bool = False) -> str:
        found = self.distance(group, scaled, bottom)
        known = [r[0] for r in self.genomes(group).select("name").distinct().orderBy("name").collect()]
        labels = [f"ref{n}" if str(n).isdigit() else str(n) for n in known]  # numbers name branches
        return tree.write_newick(phylogeny.neighbour_joining(phylogeny.matrix_of(found, known), labels))

    def make_tree(self, group: str | None = None, scaled: int | None = None, bottom: bool = False) -> str:
        """Sketch, distances, neighbour joining, each skipped where its result is there; the tree is written and set as the phylogeny."""
        path = f"{self.folders.phylogeny}/{group or 'tree'}.nwk"
        if not os.path.exists(path):
            Path(path).write_text(self.neighbour_joining(group, scaled, bottom) + "\n")
        if group:
            self.config.group_set(group, phylogeny_path=path)
        else:
            self.config.set(phylogeny_path=path)
        self.save()
        return path

    def finish_tree(self, template: str | None = None) -> str:
        """The groups' trees in a template with {{group}}; a lone group needs none."""
        made = {g: Path(x.phylogeny_path).read_text() for g, x in self.config.groups.items() if x.phylogeny_path}
        if template is None and len(made) != 1:
            raise ValueError("a template is needed to join several groups")
        text = tree.splice(Path(template).read_text(), made) if template else next(iter(made.values()))
        path = f"{self.folders.phylogeny}/phylogeny.nwk"
        Path(path).write_text(text.strip() + "\n")
        self.config.set(phylogeny_path=path)
        self.save()
        return path

    def fake_tree(self) -> str:
        """A balanced tree over all sequences."""
        found = sorted(r["name"] for r in self.genomes().select("name").collect())
        path = f"{self.folders.phylogeny}/phylogeny.nwk"
        Path(path).write_text(tree.write_newick(tree.number_branches(tree.balanced(found))) + "\n")
        self.config.set(phylogeny_path=path)
        self.save()
        return path

    def tree(self) -> tree.Node:
        if not self.config.phylogeny_path:
            raise ValueError("no phylogeny is set")
        return tree.load_newick(Path(self.config.phylogeny_path).read_text())

    # ---- build and classify ----

    def build(self, partitions: int | None = None, arrow: bool = True) -> None:
        k, _, _ = self.config.build_params()
        nodes = tree.nodes_frame(self.spark, self.tree())
        genomes = self.genomes()
        placed = genomes.join(F.broadcast(nodes.where("type = 'Leaf'").select("name", "node_id")), "name", "left")
        lost = [r["name"] for r in placed.where("node_id is null").select("name").limit(5).collect()]
        if lost:
            raise ValueError(f"not in the tree: {lost}")
        build.save_table(build.kmer_table(placed, nodes, k, arrow=arrow), self.folders.kmers, partitions)
        nodes.write.mode("overwrite").parquet(self.folders.nodes)
        reports.accession_ids(genomes).coalesce(1).write.mode("overwrite").csv(self.folders.accessions)

    def classify(self, reads: str | list[str], out: str, paired: bool = False, alpha: float = classify.ALPHA, cpm: float = classify.CPM, keep_zeros: bool = False, partitions: int | None = None) -> ResultFolders:
        """Raw rows, summaries and matrices of read files."""
        files = sequences.samples_of(sequences.list_files(reads) if isinstance(reads, str) else reads)
        if paired:
            pairs = sequences.mates(files)
            found = None
            for a, b in pairs:
                one = sequences.paired(sequences.reads(self.spark, [a]), sequences.reads(self.spark, [b]))
                found = one if found is None else found.unionByName(one)
        else:
            found = sequences.single(sequences.reads(self.spark, files))
        if partitions:
            found = found.repartition(partitions)
        table = build.load_table(self.spark, self.folders.kmers)
        if dict(table.dtypes)["kmer"] == "bigint":
            table = table.select(F.col("kmer").alias("code"), "node")
            hits = _by_code(found, table, self.config.k)
        else:
            hits = classify.look_up(classify.read_kmers(found, self.config.k), table)
        nodes = self.spark.read.parquet(self.folders.nodes)
        result = classify.classify_hits(hits, nodes, alpha)
        folders = ResultFolders(out)
        reports.write_raw(result, folders.of("phy", "raw"))
        raw = reports.read_raw(self.spark, folders.of("phy", "raw"))
        counted = results.counts(raw.withColumn("node", F.regexp_replace("node", "^p", "").cast("int")))
        counted.write.mode("overwrite").parquet(folders.of("phy", "counts"))
        self.cutoff(out, cpm, keep_zeros)
        return folders

    def cutoff_matrices(self, classified: str, split: str, out: str, cpm: float) -> None:
        """Summaries of two matrices that came from elsewhere, with another cutoff. They must have the same samples."""
        nodes = self.spark.read.parquet(self.folders.nodes)
        results.checked(*(self.spark.read.option("header", True).csv(p) for p in (classified, split)))
        sl, ml = (reports.read_matrix(self.spark, p, v, nodes) for p, v in ((classified, "sl"), (split, "ml")))
        both = results.add_frames(sl.withColumn("ml", F.lit(0).cast("bigint")), ml.withColumn("sl", F.lit(0).cast("bigint")), ["sample", "node"], ["sl", "ml"])
        reports.write_csv(reports.labelled(results.summarise(both, nodes, cpm), nodes), ResultFolders(out).of("phy", "summary"))

    def memory(self, log: str, out: str) -> DataFrame:
        """Memory by job and moment of a log of lines pid<tab>job<tab>message."""
        lines = self.spark.read.option("sep", "\t").schema("pid string, job string, line string").csv(log)
        found = analytics.job_memory(analytics.read_log(lines))
        reports.write_csv(found.orderBy("job"), out, one_file=True)
        return found

    def cutoff(self, out: str, cpm: float, keep_zeros: bool = False) -> None:
        """Summaries and matrices again from saved counts, with another cutoff."""
        folders, nodes = ResultFolders(out), self.spark.read.parquet(self.folders.nodes)
        counted = self.spark.read.parquet(folders.of("phy", "counts"))
        reports.write_csv(reports.labelled(results.summarise(counted, nodes, cpm), nodes), folders.of("phy", "summary"))
        samples = sorted(r["sample"] for r in counted.select("sample").distinct().collect())
        reports.write_matrix(counted, "sl", samples, folders.of("phy", "classified"), keep_zeros, nodes)
        reports.write_matrix(counted, "ml", samples, folders.of("phy", "split"), keep_zeros, nodes)

    def to_taxonomy(self, out: str, dump: DataFrame, leaf_taxids: DataFrame) -> DataFrame:
        """Counts by taxid, rolled up, with rank and name. dump: taxid, parent, rank, name; leaf_taxids: name, taxid."""
        folders, nodes = ResultFolders(out), self.spark.read.parquet(self.folders.nodes)
        leaves = nodes.where("type = 'Leaf'")
        lost = [r["name"] for r in taxonomy.missing_taxids(leaves.select("name"), leaf_taxids).limit(5).collect()]
        if lost:
            raise ValueError(f"no taxid for {lost}")
        lines = taxonomy.lineages(dump)
        own = leaves.select(F.col("node_id").alias("leaf"), "name").join(leaf_taxids, "name").join(lines, "taxid").select("leaf", "lineage")
        clades = taxonomy.common_prefixes(nodes, own)
        counted = self.spark.read.parquet(folders.of("phy", "counts"))
        rolled = taxonomy.attach(taxonomy.roll_up(taxonomy.by_taxid(counted, clades), lines), dump)
        reports.write_csv(rolled, folders.of("tax", "summary"))
        return rolled

    def draw(self, out: str, sample_colours: dict[str, str], log: bool = False, cpm: float = 0.0, groups: list[tuple[str, str]] | None = None) -> None:
        """Tree-colour tables of the classified, the split and all counts, each rolled up the tree, and cut off by its own sums. groups: (sample, group), drawn as one sample."""
        folders, nodes = ResultFolders(out), self.spark.read.parquet(self.folders.nodes)
        counted = self.spark.read.parquet(folders.of("phy", "counts")).where("node > 0")
        if groups:
            counted = results.group_samples(counted, self.spark.createDataFrame(groups, "sample string, group string"))
        rolled = phylo.roll_up(counted, nodes, ["sample"], ["sl", "ml"])
        for name, value in (("drawing_classified", F.col("sl")), ("drawing_splits", F.col("ml")), ("drawing", F.col("sl") + F.col("ml"))):
            coloured = reports.labelled(drawing.colour_table(rolled.select("sample", "node", value.alias("cnt")), sample_colours, log, cpm), nodes)
            reports.write_drawing(coloured.select("label", "colour"), f"{out}/phy/{name}")


def _by_code(reads: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Reads' k-mers against a table of codes: the codes are made from the strings by built-in functions, so reads stay in the JVM."""
    from cladeforge.functions import kmers

    return classify.read_kmers(reads, k).withColumn("code", kmers.encode("kmer")).join(table, "code", "left").drop("code")
