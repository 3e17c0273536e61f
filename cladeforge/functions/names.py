"""Names of files, samples, nodes and accessions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file endings of sequences and of reads.
COMPRESSED = r"(\.tar)?\.gz$"
READ_FILE = r"(\S+)\.(fa|fna|ffn|fq|fasta|fastq)(\.tar)?(\.gz)?$"
FASTA, FASTQ = (".fasta", ".fna", ".fa"), (".fastq", ".fq")


def base_name(path: Column | str) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def drop_compression(name: Column | str) -> Column:
    return F.regexp_replace(name, COMPRESSED, "")


def format_name(path: Column | str, drop_compressed: bool = False) -> Column:
    """A genome's name: the base name without .fna or .faa; names of digits alone get the prefix ref."""
    name = base_name(path)
    if drop_compressed:
        name = drop_compression(name)
    name = F.regexp_replace(name, r"\.(fna|faa)", "")
    return F.when(name.rlike(r"^\d+$"), F.concat(F.lit("ref"), name)).otherwise(name)


def sample_name(path: Column | str) -> Column:
    return F.regexp_replace(drop_compression(base_name(path)), r"\.(fasta|fastq|fna|fa|fq)$", "")


def file_format(path: Column | str) -> Column:
    """fasta or fastq; null for anything else."""
    name = drop_compression(path)
    return F.when(name.rlike(r"\.(fasta|fna|fa)$"), "fasta").when(name.rlike(r"\.(fastq|fq)$"), "fastq")


def format_of(path: str) -> str:
    """The driver's twin of :func:`file_format`, which raises. .tar.gz is read as a gzip stream."""
    if path.endswith(".tar"):
        raise ValueError(f"archives are not unpacked: {path}")
    name = re.sub(COMPRESSED, "", path)
    if name.endswith(FASTA):
        return "fasta"
    if name.endswith(FASTQ):
        return "fastq"
    raise ValueError(f"no read or sequence format is known for {path}")


def accession(header: Column | str) -> Column:
    """What stands between > and the first white space or bar."""
    return F.nullif(F.regexp_extract(header, r"^>?([^\s|]+)", 1), F.lit(""))


def header_taxid(header: Column | str) -> Column:
    return F.nullif(F.regexp_extract(header, r"\|(?:kraken:)?taxid\|(\d+)(?=[\s|]|$)", 1), F.lit(""))


def legacy_id(header: Column | str) -> Column:
    """An id without its version."""
    return F.regexp_replace(accession(header), r"\.\d+$", "")


def node_number(label: Column | str) -> Column:
    """p12 and 12 are the same node."""
    return F.regexp_replace(label, r"^p(\d+)$", "$1")


def node_label(name: Column, kind: Column) -> Column:
    return F.when(kind == "Branch", F.concat(F.lit("p"), name)).otherwise(name)


def clean_newick(text: Column | str) -> Column:
    """Quotes go, and the endings of file names before a colon."""
    return F.regexp_replace(F.regexp_replace(text, "'", ""), r"\.(fna|faa)(\.tar\.gz|\.gz)?:", ":")


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.substring(a, F.lit(1), F.array_max(same))


def parse_hit(token: Column | str) -> Column:
    """struct<node, cnt> of p4:5."""
    return F.struct(F.regexp_extract(token, r"^p?(\d+):", 1).cast("int").alias("node"), F.regexp_extract(token, r":(\d+)$", 1).cast("bigint").alias("cnt"))


def hits_text(hits: Column | str) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("p"), h["node"].cast("string"), F.lit(":"), h["cnt"].cast("string"))), " ")


def log_time(line: Column | str) -> Column:
    return F.try_to_timestamp(F.regexp_extract(line, r"^(\d\d/\d\d/\d{4} \d\d:\d\d:\d\d [AP]M)", 1), F.lit("MM/dd/yyyy hh:mm:ss a"))


def log_took(line: Column | str) -> Column:
    return F.regexp_extract(line, r"took ([0-9.]+?) ?s", 1).try_cast("double")


def log_memory(line: Column | str, kind: str) -> Column:
    """kind: RSS or VSZ, in GB."""
    return F.regexp_extract(line, rf"{kind}: ([0-9.]+)Gb", 1).try_cast("double")
