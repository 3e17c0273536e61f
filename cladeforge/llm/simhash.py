"""SimHash near-duplicates (operator 7): deletion-variant signatures.

Fingerprints within 3 bits, cut into 2 segments of 32 bits, differ by at most one bit in one of the segments. So every distinct
fingerprint is indexed under its one-wildcard variants (segment, bit left out, other 31 bits): two fingerprints of a link meet under at least one key. Runs of equal keys are then
verified on all 64 bits. Inside a run only a spanning forest of the links is emitted, so a group of near copies gives a row for each member and not for each pair.
Links become components by iterated joins. Texts with equal fingerprints are one node.

A run of more than ``run_limit`` fingerprints is dealt anew by the four bytes of its other segment (3 differing bits leave one byte
equal), and what is still above the limit by three of six pieces of that segment (3 differing bits leave three pieces equal). Neither loses a link. What shares a key and three pieces
differs in 17 bits at most, so a task holds 131,072 fingerprints of one run at most, whatever the table.

Defined results: null or empty texts, and texts of white space, have fingerprint 0 and link with any other fingerprint of 3 bits or fewer; very long texts count whole;
equal fingerprints and ties are one class, named by its smallest id; repeated rows are kept each; a null id never names a component unless all its documents have null ids;
an empty table gives an empty table. Extra columns stay out of the way, as only key, text and those asked for by ``carry`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import arrow_batches, materialize, table
from cladeforge.llm.graph import connected_components

SEED, MAX_BITS, BITS, WIDTH = 42, 3, 64, 32
VARIANT_ROWS, RUN_ROWS = 100_000, 4_000_000


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text; runs of equal shingles count as often as they occur."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    h = np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in spans), np.uint64, len(parts) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 4096):
        ones += np.unpackbits(h[lo : lo + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h))
    return int(bits.view(">u8")[0])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, fp): fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(_signed(np.fromiter((fingerprint(t, words, seed) for t in texts), np.uint64, len(texts))))

    return docs.select(F.col(key).cast("long").alias(key), *carry, made(F.col(text)).alias("fp"))


def variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): for each segment and bit, the segment with that bit left out, tagged by segment and bit in the top 7 bits."""
    spark = distinct.sparkSession
    rows = distinct.count()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-rows // VARIANT_ROWS))  # a row becomes BITS rows
    spread = distinct.select("fp").repartition(tasks).select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    spread = spread.withColumn("part", F.expr(f"shiftrightunsigned(fp, bit div {WIDTH} * {WIDTH}) & {(1 << WIDTH) - 1}L")).withColumn("at", F.col("bit") % WIDTH)
    key = "shiftleft(cast(bit as bigint), 57) | (part & (shiftleft(1L, at) - 1)) | shiftleft(shiftrightunsigned(part, at + 1), at)"
    return spread.select(F.expr(key).alias("key"), "fp")


def _other(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """The segment that a variant key does not hold."""
    return np.where((key >> np.uint64(BITS - 7)) < np.uint64(WIDTH), fp >> np.uint64(WIDTH), fp & np.uint64((1 << WIDTH) - 1))


def by_bytes(other: np.ndarray) -> Iterator[np.ndarray]:
    """The four bytes of a segment, each told from the others."""
    for i in range(4):
        yield (other >> np.uint64(8 * i)) & np.uint64(255) | np.uint64(i << 32)


def by_pieces(other: np.ndarray) -> Iterator[np.ndarray]:
    """All three of the six pieces of a segment (two of 6 bits, four of 5)."""
    cuts = [0, 6, 12, 17, 22, 27, 32]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i, three in enumerate(combinations(masks, 3)):
        yield other & np.uint64(sum(three)) | np.uint64(i << 32)


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Edges (n, 2) of a spanning forest of the links among distinct fingerprints: each one leaves the pool when it is first reached."""
    edges, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                edges.append(np.stack([np.full(len(found), x), found], axis=1))
                queue += list(found)
                left = left[~near]
    return np.concatenate(edges) if edges else np.empty((0, 2), np.uint64)


def runs(keyed: DataFrame, max_bits: int, run_limit: int | None, rows: int) -> DataFrame:
    """(a, b, long_run) from about ``rows`` rows (key, fp) or (key, variant, fp): links inside each run of equal keys, or (variant or key, fp, true) for each row of a run above the limit."""
    told = "variant" if "variant" in keyed.columns else "key"

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Reads rows sorted by key; the last run of a batch waits for the next one unless it is above the limit."""
        held = np.empty((0, 3), np.int64)  # key, fingerprint, what a long run is told by
        long_key = None

        def passed(part: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": part[:, 2], "b": part[:, 1], "long_run": True})

        def done(part: np.ndarray) -> Iterator[pd.DataFrame]:
            keys, fps = part[:, 0], np.ascontiguousarray(part[:, 1]).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            pair = starts[sizes == 2]
            a, b = fps[pair], fps[pair + 1]
            ok = np.bitwise_count(a ^ b) <= max_bits
            out = [np.stack([a[ok], b[ok]], axis=1)]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                if run_limit and n > run_limit:
                    yield passed(part[s : s + n])
                else:
                    out.append(forest(fps[s : s + n], max_bits))
            got = np.unique(np.concatenate(out), axis=0)
            if len(got):
                yield pd.DataFrame({"a": _signed(got[:, 0]), "b": _signed(got[:, 1]), "long_run": False})

        for pdf in batches:
            new = pdf[["key", "fp", told]].to_numpy().reshape(-1, 3)
            if long_key is not None and len(new):
                n = np.searchsorted(new[:, 0], long_key, side="right")
                if n:
                    yield passed(new[:n])
                new = new[n:]
            if not len(new):
                continue
            new, long_key = np.concatenate([held, new]), None
            last = np.searchsorted(new[:, 0], new[-1, 0])
            if last:
                yield from done(new[:last])
            held = new[last:]
            if run_limit and len(held) > run_limit:
                yield passed(held)
                long_key, held = held[0, 0], held[:0]
        if len(held):
            yield from done(held)

    n = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RUN_ROWS))
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInPandas(meet, "a long, b long, long_run boolean")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, run_limit: int | None = 4096) -> DataFrame:
    """(a, b): links that join all fingerprints within ``max_bits`` of each other, directly or through others."""

    def anew(kinds: Callable[[np.ndarray], Iterator[np.ndarray]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Rows of the long runs again, once for each part of the segment that their variant key does not hold."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                variant, fp = pdf["variant"].to_numpy().view(np.uint64), pdf["fp"].to_numpy().view(np.uint64)
                for part in kinds(_other(variant, fp)):
                    yield pd.DataFrame({"variant": _signed(variant), "part": _signed(part), "fp": _signed(fp)})

        return run

    rows = BITS * distinct.count()
    met = materialize(runs(variants(distinct), max_bits, run_limit, rows), "runs", 16 * rows)
    found = met.where("not long_run").select("a", "b")
    for kinds, parts, limit in ((by_bytes, 4, run_limit), (by_pieces, 20, None)):
        rest = met.where("long_run").select(F.col("a").alias("variant"), F.col("b").alias("fp"))
        if rest.isEmpty():
            break
        # Runs go by a hash of variant and part. Should two share one, links are verified on all bits, so their mix loses and adds none.
        again = rest.distinct().mapInPandas(anew(kinds), "variant long, part long, fp long").select(F.xxhash64("variant", "part").alias("key"), "variant", "fp")
        rows = parts * rest.count()
        met = materialize(runs(again, max_bits, limit, rows), "runs", 16 * rows)
        found = found.unionByName(met.where("not long_run").select("a", "b"))
    return found.distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = MAX_BITS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, fp, component, component_id): component is a fingerprint that names the class, component_id its smallest key."""
    with arrow_batches(docs.sparkSession):
        own = materialize(fingerprints(docs, key, text, words, seed, carry), "fingerprints")
    smallest = own.groupBy("fp").agg(F.min(key).alias("least"))
    distinct = materialize(smallest, "distinct_fingerprints")
    parts = connected_components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    grouped = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = materialize(grouped, "grouped")
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(grouped.join(names, "component").select("fp", "component", "component_id"), "components")
    return own.join(named, "fp").select(key, *carry, "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable over links of at most ``max_bits`` bits."""
    return classes(docs, key, text, words, max_bits, seed).select(key, "fp", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
