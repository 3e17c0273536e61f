"""Document fingerprints (operator 5): a Merkle tree over sections, paragraphs and pieces of paragraphs.

A text is cut into sections at blank lines, sections into paragraphs at line ends, paragraphs into pieces at sentence ends and, where a sentence is
long, at spaces chosen by content; nothing is left out, so the leaves spell the text. A node's hash is that of its children's hashes and its
kind; the root is the fingerprint. Equal roots mean equal texts; where roots differ, equal branches are skipped and the first differing ones locate an edit.
Likeness of two trees: twice the code points of the leaves they share (as often as both have them) over all code points of both; 1 for two empty texts.

The next document of each is the next row of its range of ids, and texts travel once: to the range they belong to, and the first of a range also to the range before it.
Ranges are cut at quantiles of the ids, so they are even however the ids lie; an id with more rows than a range is cut further by the hash of the text. A range is
read as a stream, so a task's memory does not grow with it.

Defined results: null texts are empty; an empty text has a fixed root; very long texts are read whole; rows with the same id (ties) follow each other by the hash of the text, the next of each being
the next row; null ids come before all others; a lone document is its own next; an empty table gives an empty table. Extra columns stay out of the way, as only key and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import table

_SECTIONS = re.compile(r"(?<=\n)(?=\n)|(?<=\n\n)(?=[^\n])")
_PARAGRAPHS = re.compile(r"[^\n]*\n|[^\n]+")
_SENTENCES = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
_WORDS = re.compile(r"\S+\s*|\s+")
LONG = 48


def _hash(kind: bytes, parts: list[bytes]) -> bytes:
    return blake2b(b"".join(parts), digest_size=16, person=kind).digest()


def pieces(paragraph: str) -> list[str]:
    """Sentences; long ones are cut after words whose own hash says so, or where no word does, every LONG code points."""
    out = []
    for sentence in _SENTENCES.findall(paragraph):
        if len(sentence) <= LONG:
            out.append(sentence)
            continue
        held = ""
        for word in _WORDS.findall(sentence):
            held += word
            if crc32(word.encode("utf-8", "surrogatepass")) % 4 == 0 or len(held) >= LONG:
                out += [held[i : i + LONG] for i in range(0, len(held), LONG)]
                held = ""
        if held:
            out.append(held)
    return out


class Tree:
    """root; sections: [(hash, [(hash, start of the paragraph)])]; leaves: hash -> [count, code points]."""

    def __init__(self, text: str) -> None:
        self.leaves: Counter = Counter()
        self.sizes: dict[bytes, int] = {}
        self.sections, at = [], 0
        for section in _SECTIONS.split(text) if text else []:
            nodes = []
            for paragraph in _PARAGRAPHS.findall(section):
                hashes = []
                for piece in pieces(paragraph):
                    h = _hash(b"leaf", [piece.encode("utf-8", "surrogatepass")])
                    self.leaves[h] += 1
                    self.sizes[h] = len(piece)
                    hashes.append(h)
                nodes.append((_hash(b"paragraph", hashes), at))
                at += len(paragraph)
            self.sections.append((_hash(b"section", [h for h, _ in nodes]), nodes))
        self.root = _hash(b"root", [h for h, _ in self.sections])
        self.total = sum(n * self.sizes[h] for h, n in self.leaves.items())

    def likeness(self, other: Tree) -> float:
        if self.root == other.root:
            return 1.0
        if not self.total + other.total:
            return 1.0
        shared = sum(min(n, other.leaves[h]) * self.sizes[h] for h, n in self.leaves.items() if h in other.leaves)
        return 2 * shared / (self.total + other.total)

    def first_edit(self, other: Tree) -> int | None:
        """Where the first differing paragraph of this text starts (code points), going down differing branches only."""
        if self.root == other.root:
            return None
        for i, (h, nodes) in enumerate(self.sections):
            theirs = other.sections[i] if i < len(other.sections) else (None, [])
            if h != theirs[0]:
                for j, (p, at) in enumerate(nodes):
                    if j >= len(theirs[1]) or theirs[1][j][0] != p:
                        return at
        return self.total


def range_of(cuts: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of cuts up to (id, hash). A cut id that is there several times, as it holds several quantiles, is cut evenly over the hashes."""
    lo, hi = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    part = np.minimum((hashes / 2.0**64 + 0.5) * (hi - lo), np.maximum(hi - lo - 1, 0)).astype(np.int64)
    return np.where(hi > lo, lo + 1 + part, lo)


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = 1 << 20, least: int = 1024, most: int = 100_000) -> DataFrame:
    """One row per document with its fingerprint, that of the edited text and the likenesses (see op5). ``least`` to ``most`` ranges of ids: that many numbers go to the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    edge = rows.agg(F.min("id").alias("lo"), F.sum(F.octet_length("text")).alias("bytes")).first()
    low = max((edge["lo"] or 0) - 1, -(1 << 63))  # null ids stand before the first
    rows = rows.withColumn("place", F.coalesce("id", F.lit(low).cast("long")))
    ranges = max(least, min(most, -(-(edge["bytes"] or 0) // range_bytes)))
    cuts = rows.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts")).first()["cuts"]
    cut = spark.sparkContext.broadcast(np.sort(np.array(cuts or [], np.int64)))  # most numbers

    @F.pandas_udf("int")
    def ranged(place: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(range_of(cut.value, place.to_numpy(), hashes.to_numpy()).astype(np.int32))

    placed = rows.withColumn("range", ranged("place", "hash"))
    firsts = sorted(tuple(r) for r in placed.groupBy("range").agg(F.min(F.struct("place", "hash")).alias("f")).select("range", "f.place", "f.hash").collect())
    tails = [(p, h, firsts[i - 1][0]) for i, (_, p, h) in enumerate(firsts)]  # the first of all goes to the last range
    tails = spark.createDataFrame(tails, "place long, hash long, to int")
    heads = rows.join(F.broadcast(tails), ["place", "hash"]).groupBy("place", "hash", "to").agg(F.min("text").alias("text"))  # a row a range
    heads = heads.select(F.col("to").alias("range"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("tail"), "place", "hash", "text")
    dealt = placed.select("range", "id", F.lit(0).alias("tail"), "place", "hash", "text").unionByName(heads)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "tail", "place", "hash", "text").select("id", "tail", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, repeated = None, [None, ()]

        def one(id_, text: str, tree: Tree, following: str) -> tuple[tuple, Tree]:
            if text == following and repeated[0] == text:  # of repeated rows all but the last give the same
                return (id_, *repeated[1]), tree
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half] if half else text
            made, after = Tree(edited), Tree(following)
            told = (len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), tree.root.hex(), made.root.hex(), tree.likeness(made), tree.likeness(after), tree.first_edit(made), len(tree.sections))
            if text == following:
                repeated[:] = text, told
            return (id_, *told), after

        for pdf in batches:
            out = []
            for id_, tail, text in zip(pdf["id"].astype("Int64"), pdf["tail"], pdf["text"], strict=True):
                after = None
                if held is not None:
                    row, after = one(*held, text)
                    out.append(row)
                held = None if tail else (None if id_ is pd.NA else int(id_), text, after or Tree(text))
            if out:
                frame = pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "first_edit", "n_sections"])
                yield frame.astype({"id": "Int64", "first_edit": "Int64"})

    made = dealt.mapInPandas(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_edit long, n_sections long")
    return made.withColumnRenamed("id", key)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
