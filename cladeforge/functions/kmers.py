"""k-mer expressions: windows, reverse complements, canonical forms and 2-bit codes.

Words stay strings of ACGT or become BIGINT codes (A 0, C 1, G 2, T 3, first base most significant; k of at most 31), whose order is that of the strings.
Lower-case bases are no bases unless ``upper`` is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_K = 31
LONG_STRETCH = 1 << 22


def check_k(k: int, largest: int = 10_000) -> int:
    if not 0 < k <= largest:
        raise ValueError(f"k must be from 1 to {largest}, not {k}")
    return k


def chunks_of(k: int) -> int:
    """64-bit words that a k-mer takes."""
    return -(-check_k(k) // 32)


def largest_code(k: int) -> int:
    """4^k - 1, of the first word where k is above 32."""
    return 4 ** min(check_k(k), 32) - 1


def reverse_complement(seq: Column | str) -> Column:
    """Other characters than ACGT stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column | str) -> Column:
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer
    return F.least(kmer, reverse_complement(kmer))


def encode(kmer: Column | str) -> Column:
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def decode(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(F.col(code).cast("string") if isinstance(code, str) else code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def complement_join(old: Column | str, new: Column | str) -> Column:
    """Two mates as one sequence."""
    return F.concat(old, F.lit("N"), reverse_complement(new))


def windows(seq: Column | str, k: int) -> Column:
    """All windows of k bases in order; a window with another character is left out while scanning, in one linear pass."""
    return F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{check_k(k)}}}))"), F.lit(1))


def at_offsets(seq: Column, offsets: Column, k: int) -> Column:
    """k-mers at given 0-based offsets."""
    return F.transform(offsets, lambda p: F.substring(seq, p + 1, F.lit(k)))


def stretches(df: DataFrame, keys: list[str], k: int, seq: str = "seq", stretch: int = 1 << 16) -> DataFrame:
    """keys, _at, _seq: pieces of ``stretch`` windows that overlap by k - 1, so that no row or array holds the windows of a whole chromosome. Short sequences stay one piece."""
    cuts = F.sequence(F.lit(0), F.greatest(F.coalesce(F.length(seq), F.lit(0)) - k, F.lit(0)), F.lit(stretch))
    part = df.select(*keys, F.col(seq).alias("_whole"), F.explode(cuts).alias("_at"))
    return part.select(*keys, "_at", F.when(F.length("_whole") <= stretch, F.col("_whole")).otherwise(F.substring("_whole", F.col("_at") + 1, F.lit(stretch + k - 1))).alias("_seq"))


def explode_windows(df: DataFrame, keys: list[str], k: int, seq: str = "seq", outer: bool = False) -> DataFrame:
    """keys, ordinal (rising over valid windows), kmer (canonical). outer: a row without valid windows stays, with nulls; it is meant for reads, which are not cut."""
    if outer:
        return df.select(*keys, F.posexplode_outer(windows(seq, k)).alias("ordinal", "word")).select(*keys, "ordinal", canonical("word").alias("kmer"))
    # In two steps, as a place in a string is found by counting from its beginning.
    long = stretches(df, keys, check_k(k), seq, LONG_STRETCH).select(*keys, F.col("_at").alias("_base"), F.col("_seq").alias("_long"))
    found = stretches(long, [*keys, "_base"], k, "_long").select(*keys, (F.col("_base") + F.col("_at")).alias("_at"), F.posexplode(windows("_seq", k)).alias("_i", "word"))
    return found.select(*keys, (F.col("_at") + F.col("_i")).alias("ordinal"), canonical("word").alias("kmer"))


def explode_offsets(df: DataFrame, keys: list[str], k: int, seq: str = "seq", stretch: int = 4096) -> DataFrame:
    """keys, pos (0-based offset), word (as it stands). Long sequences are first cut into overlapping stretches, so each window is read near its start."""
    check_k(k)
    size = F.length(seq)
    cuts = F.when(size >= k, F.sequence(F.lit(0), size - k, F.lit(stretch))).otherwise(F.array().cast("array<int>"))
    part = df.select(*keys, F.explode(cuts).alias("_at"), F.col(seq).alias("_seq")).withColumn("_seq", F.substring(F.col("_seq"), F.col("_at") + 1, F.lit(stretch + k - 1)))
    steps = F.sequence(F.lit(0), F.length("_seq") - k)
    out = part.select(*keys, "_at", "_seq", F.explode(steps).alias("_i")).select(*keys, (F.col("_at") + F.col("_i")).alias("pos"), F.substring(F.col("_seq"), F.col("_i") + 1, F.lit(k)).alias("word"))
    return out.where(F.col("word").rlike(f"^[ACGT]{{{k}}}$"))


def codes_of(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, canonical codes) of a sequence's valid windows."""
    raw = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)
    n = len(raw) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    base = np.full(256, 4, np.uint8)
    base[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    code = base[raw]
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    code = code.astype(np.int64) & 3
    ahead, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        ahead = (ahead << 2) | code[j : j + n]
        back |= (3 - code[j : j + n]) << (2 * j)
    return at, np.minimum(ahead, back)[at]


def explode_codes(df: DataFrame, keys: list[str], k: int, seq: str = "seq") -> DataFrame:
    """Arrow twin of :func:`explode_windows`: keys, pos, code; for long sequences, where string windows cost most."""
    check_k(k, MAX_K)
    fields = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                pos, code = codes_of(row[-1] or "", k)
                pos = pos + row[-2]
                for lo in range(0, len(pos), 1 << 18):
                    out = pd.DataFrame({"pos": pos[lo : lo + (1 << 18)], "code": code[lo : lo + (1 << 18)]})
                    for i, name in enumerate(keys):
                        out[name] = row[i]
                    yield out[[*keys, "pos", "code"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items()) + ", pos long, code long"
    return stretches(df, keys, k, seq, LONG_STRETCH).select(*keys, "_at", F.coalesce("_seq", F.lit("")).alias("_seq")).mapInPandas(run, schema)
