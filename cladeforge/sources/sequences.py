"""Sequence files: genomes and reads in FASTA and FASTQ, plain or gzip, as DataFrames.

Genomes are one row a file. Reads are streamed in records, so a file of any size is read in bounded memory. A gzip file is one task by nature; what follows should be
dealt anew (``partitions``).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.functions import names


def list_files(folder: str, ending: str | None = None) -> list[str]:
    """Regular files that are not hidden, by path, links resolved."""
    found = [os.path.realpath(os.path.join(folder, f)) for f in sorted(os.listdir(folder)) if not f.startswith(".")]
    return [f for f in found if os.path.isfile(f) and (ending is None or f.endswith(ending))]


def smallest_first(spark: SparkSession, paths: list[str], first: int | None = None) -> DataFrame:
    """(path, length) by size; ``first`` keeps the first n in order of path."""
    found = spark.read.format("binaryFile").load(sorted(paths)[:first] if first else paths).select("path", "length")
    return found.orderBy("length", "path")


def genomes(spark: SparkSession, paths: list[str], keep_first_break: bool = False) -> DataFrame:
    """(path, name, accession, taxid, seq): contigs joined by N. The first header gives accession or taxid; a file without both, or without a header, is an error.

    ``keep_first_break``: the first header is an N too, as sketches and simulated reads want it."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    head = F.regexp_extract("value", r"\A([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"(?m)^[^\n]*>[^\n]*$", "N"), r"\s+", "")
    rows = files.select("path", head.alias("head"), (body if keep_first_break else F.substring(body, 2, 2_147_483_647)).alias("seq"))
    rows = rows.withColumns({"accession": names.accession("head"), "taxid": names.header_taxid("head"), "name": names.format_name("path", True)})
    problem = F.when(~F.contains("head", F.lit(">")), "no header in ").when(F.col("accession").isNull() & F.col("taxid").isNull(), "neither accession nor taxid in ")
    return rows.withColumn("seq", F.when(problem.isNotNull(), F.raise_error(F.concat(problem, "path"))).otherwise(F.col("seq"))).select("path", "name", "accession", "taxid", "seq")


def contigs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ordinal, id, seq): one row a contig."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.slice(F.split("value", r"(?m)^>"), 2, 2_147_483_647)).alias("ordinal", "record"))
    head = F.regexp_extract("record", r"\A([^\r\n]*)", 1)
    bar = F.split(head, r"\|")
    id_ = F.when(F.size(bar) > 1, F.get(bar, F.lit(1))).otherwise(F.regexp_extract(head, r"^(\S*)", 1))
    return files.select("path", "ordinal", id_.alias("id"), F.regexp_replace(F.regexp_replace("record", r"\A[^\n]*\n?", ""), r"\s+", "").alias("seq"))


def _numbered(spark: SparkSession, paths: list[str], separator: str | None = None) -> DataFrame:
    """(path, n, value): lines with their number in the file. Lines are counted by block of the file, so no file is numbered in one task."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    block = F.col("_metadata.file_block_start").alias("block")
    lines = reader.text(paths).select(F.col("_metadata.file_path").alias("path"), block, F.monotonically_increasing_id().alias("at"), F.col("value"))
    blocks = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    start = F.sum("m").over(Window.partitionBy("path").orderBy("block")) - F.col("m")
    starts = blocks.withColumn("start", start).select("path", "block", "first", "start")  # a row a block
    return lines.join(starts, ["path", "block"]).select("path", (F.col("start") + F.col("at") - F.col("first")).alias("n"), "value")


def fasta_reads(spark: SparkSession, paths: list[str], partitions: int | None = None) -> DataFrame:
    """(path, sample, ordinal, read_id, bases). A record starts where a line does, with >; another > inside a header belongs to it. No file is held whole; ordinals count a file's records from 1.

    What stands before the first record of a file is left out."""
    rows = _numbered(spark, paths, "\n>")
    rows = rows.withColumn("headed", (F.col("n") > 0) | F.startswith("value", F.lit(">")))
    firsts = rows.where("n = 0").select("path", F.col("headed").cast("int").alias("own"))  # a row a file
    rows = rows.where("headed").withColumn("value", F.when(F.col("n") == 0, F.expr("substring(value, 2)")).otherwise(F.col("value"))).join(firsts, "path")
    rows = rows.repartition(partitions) if partitions else rows
    id_ = F.regexp_extract("value", r"\A(\S+)", 1)
    bases = F.regexp_replace(F.regexp_replace("value", r"\A[^\n]*\n?", ""), r"\s+", "")
    return rows.select("path", names.sample_name("path").alias("sample"), (F.col("n") + F.col("own")).alias("ordinal"), id_.alias("read_id"), bases.alias("bases"))


def fastq_reads(spark: SparkSession, paths: list[str], partitions: int | None = None) -> DataFrame:
    """Like :func:`fasta_reads`, for records of four lines; an id is the whole header line after @.

    A quality line may begin with @ too, so lines are told by their number and not by their first letter."""
    lines = _numbered(spark, paths).where("n % 4 < 2")
    records = lines.groupBy("path", (F.floor(F.col("n") / 4) + 1).alias("ordinal")).agg(F.max_by("value", -F.col("n")).alias("head"), F.max_by("value", "n").alias("bases"))
    records = records.where("head <> ''")
    records = records.repartition(partitions) if partitions else records
    return records.select("path", names.sample_name("path").alias("sample"), "ordinal", F.regexp_extract("head", r"^@(.*?)\s*$", 1).alias("read_id"), F.trim("bases").alias("bases"))


def reads(spark: SparkSession, paths: list[str], partitions: int | None = None) -> DataFrame:
    """Reads of files of either format, by their names."""
    by: dict[str, list[str]] = {}
    for p in paths:
        by.setdefault(names.format_of(p), []).append(p)
    frames = [(fasta_reads if kind == "fasta" else fastq_reads)(spark, ps, partitions) for kind, ps in sorted(by.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def single(found: DataFrame) -> DataFrame:
    """(sample, read_id, seq): each read with its closing N; an empty record is kept, and will be unclassified."""
    return found.select("sample", "read_id", F.concat("bases", F.lit("N")).alias("seq"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by their place in the two files: sequence R1 N R2 N, id the common beginning of both ids, sample the lesser name."""
    a, b = (df.select("ordinal", *[F.col(c).alias(f"{c}_{i}") for c in ("sample", "read_id", "bases")]) for i, df in ((1, first), (2, second)))
    both = a.join(b, "ordinal")
    return both.select(F.least("sample_1", "sample_2").alias("sample"), names.common_prefix(F.col("read_id_1"), F.col("read_id_2")).alias("read_id"), F.concat("bases_1", F.lit("N"), "bases_2", F.lit("N")).alias("seq"))


def samples_of(paths: list[str]) -> list[str]:
    """Read files by their names; archives and unknown endings are an error when read."""
    return [p for p in sorted(paths) if re.match(names.READ_FILE, os.path.basename(p))]


def mates(paths: list[str]) -> list[tuple[str, str]]:
    """Files in pairs: each with the one whose name it shares the longest beginning with."""
    left = samples_of(paths)
    if len(left) % 2:
        raise ValueError(f"{len(left)} files cannot be paired")
    out = []
    while left:
        a = left.pop(0)
        b = max(left, key=lambda x: len(os.path.commonprefix([os.path.basename(a), os.path.basename(x)])))
        left.remove(b)
        out.append((a, b))
    return out


def write_fasta(found: DataFrame, path: str, mate: bool = False) -> None:
    """(read_id, seq) as FASTA text."""
    found.select(F.concat(F.lit(">"), "read_id", F.lit("\n"), F.col("mate" if mate else "seq")).alias("value")).write.mode("overwrite").text(path)
