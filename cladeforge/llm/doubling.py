"""Prefix doubling with Spark's sort alone: the plain form of operator 3, for corpora whose positions may be shuffled several times over.

A position's first rank is the value of its first 8 bytes. At offsets 8 and 16 Spark pairs the ranks of a position and of the one that far on, sorts the pairs, and ranks anew: equal pairs get
one rank, in sorted order, and unique ones leave, as no longer string that starts there is repeated. The last offset makes pairs that spell ``threshold`` bytes; each group of
equal pairs has its smallest document, and the others' windows are removed. Ranks are exact: they are compared, never hashed.

Every round shuffles each position left three times, which is why :mod:`cladeforge.llm.suffix` serves the query; both give the same rows (tested). Null texts are empty, null ids
come first and are one document, repeated rows get equal results, an empty table gives an empty table. Extra columns stay out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeforge.llm.common import materialize, size_of, with_rows

FIRST, POSITION_BYTES = 8, 30


def positions(docs: DataFrame) -> DataFrame:
    """(row, id, pos, rank) of every position with FIRST bytes left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, id_, text in zip(pdf["row"], pdf["id"], pdf["text"], strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) >= FIRST:
                    rank = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, FIRST)).view(">u8")[:, 0]
                    yield pd.DataFrame({"file": row["file"], "at": row["at"], "id": id_, "pos": np.arange(len(rank)), "rank": (rank ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)})

    return docs.mapInPandas(run, "file long, at long, id long, pos long, rank long")


def paired(ranked: DataFrame, offset: int) -> DataFrame:
    """(file, at, id, pos, a, b): ranks of a position and of the one ``offset`` on. Where the other one is unique or past the end, so is the pair."""
    on = ranked.select("file", "at", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("b"))
    return ranked.withColumnRenamed("rank", "a").join(on, ["file", "at", "pos"])


def ranked_anew(pairs: DataFrame) -> DataFrame:
    """(file, at, id, pos, rank) of the pairs that occur more than once; ranks follow the order of the pairs."""
    repeated = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("a", "b")
    ranks = materialize(repeated.select("a", "b", F.monotonically_increasing_id().alias("rank")), "ranks")
    return materialize(pairs.join(ranks, ["a", "b"]).select("file", "at", "id", "pos", "rank"), "ranked")


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 50) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256; ``threshold`` is 32 to 64."""
    null = -(1 << 63)
    rows = with_rows(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(null)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    ranked, length = ranked_anew(paired(materialize(positions(rows), "positions", POSITION_BYTES * size_of(rows)), FIRST)), 2 * FIRST
    while 2 * length <= threshold:
        ranked, length = ranked_anew(paired(ranked, length)), 2 * length
    pairs = paired(ranked, threshold - length)
    first = pairs.groupBy("a", "b").agg(F.min("id").alias("first"))
    hit = pairs.join(first, ["a", "b"]).where("id > first").groupBy("file", "at").agg(F.collect_list("pos").alias("starts"))
    hit = hit.select(F.struct("file", "at").alias("row"), "starts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for id_, body, starts in zip(pdf["id"], pdf["text"], pdf["starts"], strict=True):
                data = np.frombuffer(body.encode("utf-8", "surrogatepass"), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                if starts is not None:
                    np.add.at(edge, np.asarray(starts), 1)
                    np.add.at(edge, np.asarray(starts) + threshold, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((None if id_ == null else id_, len(data), int(gone.sum()), runs, sha256(data[~gone].tobytes()).hexdigest()))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"id": "Int64"})

    done = rows.join(hit, "row", "left").select("id", "text", "starts").mapInPandas(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumnRenamed("id", key)
