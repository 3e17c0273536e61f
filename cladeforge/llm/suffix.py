"""Suffix-array dedup (operator 3): prefix doubling over byte positions, dealt by Spark.

A position's rank at length L is a 64-bit name of the L bytes there; the name at 2L is made of the pair (name at i, name at i + L), with offsets
1, 2, 4, 8, 16, and at last 18 for the threshold of 50. Names replace ordinals, which only the order of suffixes would need, so equal strings rank equal
everywhere and no round sorts the whole corpus. Spark brings ranks together twice, and drops unique ones each time:

1. at 32 bytes, only for positions that are the least of some 19 in a row (any 50 bytes hold such a one, chosen by content alone);
   a window whose least position is unique in the corpus is unique itself and leaves;
2. at 50 bytes, for the windows left, which are in order with the smallest document that has them.

Documents are dealt to chunks of bounded size by their id. A chunk sends each name once, so neither a common passage nor a group of copies
piles up anywhere; answers are one bit a name. Texts are shuffled once, and all passes over a chunk read that one shuffle. Whole copies are
found first, by digests, and take no part.

A chunk sends a row to each part that one of its names belongs to, so rows are never more than names and grow with the text, not with its square.

Defined results: null texts are empty; documents below the threshold lose nothing; very long texts are read whole, in one chunk; equal ids (ties) do not cover each other; null ids count as
smaller than all others, and as one document; repeated rows get equal results; an empty table gives an empty table. Extra columns stay out of the way, as only key and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import salt, table

THRESHOLD, SEED_LENGTH = 50, 32
SPAN = THRESHOLD - SEED_LENGTH + 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_ONE, _48 = np.uint64(1), np.uint64((1 << 48) - 1)
BLOCK_BYTES = 1 << 20
NULL_ID = -(1 << 63)


def _name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks."""
    h = a * _A
    h += b * _B
    h ^= h >> np.uint64(32)
    return h


def ranks(data: np.ndarray, length: int = SEED_LENGTH) -> np.ndarray:
    """Ranks of all positions at a power of two, by doubling; the array ends where a string would."""
    h = (data.astype(np.uint64) + _ONE) * _C
    for i in range(length.bit_length() - 1):
        step = 1 << i
        h = _name(h[:-step], h[step:])
    return h


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each ``width`` values in a row, by doubling."""
    step = 1
    while 2 * step <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return f(x[: len(x) - rest], x[rest:]) if rest else x


PACKED = "c int, ids binary, sizes binary, data binary"


def pack(batches: Iterator[pd.DataFrame], flush_bytes: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Documents (c, id, text) as compressed bundles by chunk, so that what is shuffled is small."""
    import zstandard

    small = zstandard.ZstdCompressor(level=3)
    held: dict[int, tuple[list[int], list[bytes]]] = {}
    size = 0

    def out() -> pd.DataFrame:
        rows = [(c, np.array(ids, "<i8").tobytes(), np.array([len(b) for b in texts], "<i8").tobytes(), small.compress(b"".join(texts))) for c, (ids, texts) in held.items()]
        return pd.DataFrame(rows, columns=["c", "ids", "sizes", "data"])

    for pdf in batches:
        for c, i, t in zip(pdf["c"].to_numpy(), pdf["id"].astype("Int64").fillna(NULL_ID).to_numpy(np.int64), pdf["text"], strict=True):
            ids, texts = held.setdefault(int(c), ([], []))
            ids.append(int(i))
            texts.append(t.encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= flush_bytes:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


class Chunk:
    """The distinct texts of a chunk, each under its smallest id here."""

    def __init__(self, rows: list[tuple[int, bytes]]) -> None:
        self.rows = rows
        first: dict[bytes, int] = {}
        for i, b in self.rows:
            if i < first.get(b, i + 1):
                first[b] = i
        self.first = first
        self.digests = {b: blake2b(b, digest_size=16).digest() for b in first}

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Chunk:
        import zstandard

        large, rows = zstandard.ZstdDecompressor(), []
        for ids, sizes, data in zip(pdf["ids"], pdf["sizes"], pdf["data"], strict=True):
            whole, at = large.decompress(data), 0
            for i, n in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist(), strict=True):
                rows.append((i, whole[at : at + n]))
                at += n
        return cls(rows)

    def read(self, copies: set[bytes]) -> list[Block]:
        """Texts of the threshold or more that are no copies of a smaller document elsewhere, in ascending id."""
        rows = sorted((i, b) for b, i in self.first.items() if len(b) >= THRESHOLD and b not in copies)
        at, out = 0, []
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size + len(rows[end][1]) <= BLOCK_BYTES):
                size += len(rows[end][1])
                end += 1
            out.append(Block(rows[at:end]))
            at = end
        return out


class Block:
    """Some texts end to end: ids, number of the text of each window, whether a window is inside one text, ranks, seeds and their names."""

    def __init__(self, part: list[tuple[int, bytes]]) -> None:
        self.part = part
        self.ids = np.array([i for i, _ in part], np.int64)
        lens = np.array([len(b) for _, b in part])
        self.bases = np.concatenate([[0], np.cumsum(lens)])
        data = np.frombuffer(b"".join(b for _, b in part), np.uint8)
        doc = np.repeat(np.arange(len(part), dtype=np.int32), lens)
        n = len(data) - THRESHOLD + 1
        self.doc, self.inside = doc[:n], doc[:n] == doc[THRESHOLD - 1 :]
        self.h = ranks(data)
        self.at = _seeds(self.inside, self.h)
        self.seed_docs = doc[self.at]
        self.names = _seed_names(self.h[self.at])

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, position, rank at the threshold) of the windows whose least position is repeated; a flag for each seed tells."""
        h = self.h & ~_ONE
        h[self.at[repeated]] |= _ONE
        pos = np.flatnonzero(self.inside & ((_sliding(h, SPAN, np.minimum) & _ONE) == _ONE))
        return self.doc[pos], pos, _name(self.h[pos], self.h[pos + THRESHOLD - SEED_LENGTH])


def _seeds(inside: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions that are the least of a window inside a document."""
    h = h & ~_ONE
    least = np.where(inside, _sliding(h, SPAN, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, SPAN, np.maximum) == h)


def _seed_names(h: np.ndarray) -> np.ndarray:
    """48 bits, mixed again, as least ranks are small."""
    h = (h & ~_ONE) * _C
    return (h ^ (h >> np.uint64(29))) & _48


def _pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8")[:, 0]


def _split(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices) in rising order of part and index, of the parts that occur: as many steps as values at most, however many parts there are."""
    part = part.astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1], [True]])) if len(part) else np.empty(0, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[order[a]]), order[a:b]


def _distinct(names: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each, distinct names by first appearance, document of the first appearance)."""
    if not names:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    names, docs = np.concatenate(names), np.concatenate(docs)
    codes, distinct = pd.factorize(names)
    first = np.empty(len(distinct), docs.dtype)
    first[codes[::-1]] = docs[::-1]
    return codes, distinct, first


def _texts(chunk: Chunk, parts: int) -> list[tuple[int, list[bytes]]]:
    by: dict[int, list[bytes]] = {}
    for b in sorted(chunk.first, key=chunk.digests.__getitem__):
        by.setdefault(int.from_bytes(chunk.digests[b][:8], "little") % parts, []).append(b)
    return sorted(by.items())


class Seeds:
    """The seeds of some blocks: their codes, distinct names by first appearance, and whether two documents here have one."""

    def __init__(self, blocks: list[Block]) -> None:
        docs = [b.ids[b.seed_docs] for b in blocks]
        self.codes, self.names, first = _distinct([b.names for b in blocks], docs)
        self.two = np.zeros(len(self.names), bool)
        if blocks:
            self.two[self.codes[np.concatenate(docs) != first[self.codes]]] = True


def _answers(made: pd.DataFrame) -> dict[tuple[str, int], np.ndarray]:
    return {(k, p): np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for k, p, b in zip(made["kind"], made["part"], made["bits"], strict=True)}


def _told(names: np.ndarray, parts: int, kind: str, answers: dict[tuple[str, int], np.ndarray]) -> np.ndarray:
    """The answer to each name, as it was sent."""
    out = np.zeros(len(names), bool)
    for p, at in _split(names % np.uint64(parts), parts):
        out[at] = answers[(kind, p)][: len(at)]
    return out


SENT = "part int, c int, names binary, docs binary"
ANSWER = "c int, kind string, part int, bits binary"


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = 4 << 20, part_bytes: int = 16 << 20, least: int = 64) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept (binary), spans (array of start, end in bytes)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, parts = max(least, -(-total // chunk_bytes)), max(least, -(-total // part_bytes))
    rows = rows.select(salt(chunks, "id").alias("c"), "id", "text")

    def copies_of(chunk: Chunk, answers: dict[tuple[str, int], np.ndarray]) -> set[bytes]:
        return {b for p, bs in _texts(chunk, parts) for b, yes in zip(bs, answers[("text", p)], strict=False) if yes}

    def candidates(blocks: list[Block], answers: dict[tuple[str, int], np.ndarray]) -> list[tuple[Block, np.ndarray, np.ndarray, np.ndarray]]:
        """The windows of each block that may be repeated."""
        seeds = Seeds(blocks)
        repeated, at, out = _told(seeds.names, parts, "seed", answers)[seeds.codes], 0, []
        for block in blocks:
            out.append((block, *block.windows(repeated[at : at + len(block.at)])))
            at += len(block.at)
        return out

    def send_texts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk.of(pdf)
        out = [(p, key[0], b"".join(chunk.digests[b] for b in bs), np.array([chunk.first[b] for b in bs], "<i8").tobytes()) for p, bs in _texts(chunk, parts)]
        return pd.DataFrame(out, columns=["part", "c", "names", "docs"])

    def answer_texts(pdf: pd.DataFrame) -> pd.DataFrame:
        part, out = int(pdf["part"].iloc[0]), []
        smallest: dict[bytes, int] = {}
        split = [([n[i : i + 16] for i in range(0, len(n), 16)], np.frombuffer(d, "<i8").tolist()) for n, d in zip(pdf["names"], pdf["docs"], strict=True)]
        for ns, ds in split:
            for n, d in zip(ns, ds, strict=True):
                if d < smallest.get(n, d + 1):
                    smallest[n] = d
        for c, (ns, ds) in zip(pdf["c"], split, strict=True):
            out.append((c, "text", part, np.packbits([smallest[n] < d for n, d in zip(ns, ds, strict=True)]).tobytes()))
        return pd.DataFrame(out, columns=["c", "kind", "part", "bits"])

    def send_seeds(key: tuple, pdf: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            chunk = Chunk.of(pdf)
            seeds = Seeds(chunk.read(copies_of(chunk, _answers(made))))
            for p, at in _split(seeds.names % np.uint64(parts), parts):
                out.append((p, key[0], _pack48(seeds.names[at]), np.packbits(seeds.two[at]).tobytes()))
        return pd.DataFrame(out, columns=["part", "c", "names", "docs"])

    def answer_seeds(pdf: pd.DataFrame) -> pd.DataFrame:
        part, out = int(pdf["part"].iloc[0]), []
        lists = [_unpack48(b) for b in pdf["names"]]
        two = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: len(x)] for b, x in zip(pdf["docs"], lists, strict=True)]).astype(bool)
        codes, _ = pd.factorize(np.concatenate(lists))
        often = np.bincount(codes) > 1
        often[codes[two]] = True
        bits, at = often[codes], 0
        for c, x in zip(pdf["c"], lists, strict=True):
            out.append((c, "seed", part, np.packbits(bits[at : at + len(x)]).tobytes()))
            at += len(x)
        return pd.DataFrame(out, columns=["c", "kind", "part", "bits"])

    def send_windows(key: tuple, pdf: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        """Distinct windows with the smallest id here; blocks and texts are in ascending id, so the first appearance has it, and ids come in runs."""
        out = []
        if len(pdf):
            chunk, answers = Chunk.of(pdf), _answers(made)
            found = candidates(chunk.read(copies_of(chunk, answers)), answers)
            _, names, docs = _distinct([name for *_, name in found], [block.ids[doc] for block, doc, *_ in found])
            for p, at in _split(names % np.uint64(parts), parts):
                own = docs[at]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                runs = np.stack([own[starts], np.diff(np.concatenate([starts, [len(at)]]))])
                out.append((p, key[0], names[at].astype("<u8").tobytes(), runs.astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["part", "c", "names", "docs"])

    def answer_windows(pdf: pd.DataFrame) -> pd.DataFrame:
        part, out = int(pdf["part"].iloc[0]), []
        lists = [np.frombuffer(b, "<u8") for b in pdf["names"]]
        docs = np.concatenate([np.repeat(*np.frombuffer(b, "<i8").reshape(2, -1)) for b in pdf["docs"]])
        codes, distinct = pd.factorize(np.concatenate(lists))
        smallest = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(smallest, codes, docs)
        bits, at = smallest[codes] < docs, 0
        for c, x in zip(pdf["c"], lists, strict=True):
            out.append((c, "window", part, np.packbits(bits[at : at + len(x)]).tobytes()))
            at += len(x)
        return pd.DataFrame(out, columns=["c", "kind", "part", "bits"])

    def removed(chunk: Chunk, answers: dict[tuple[str, int], np.ndarray]) -> dict[bytes, list[tuple[int, int]]]:
        """Spans to remove from each distinct text, under its smallest id here."""
        copies = copies_of(chunk, answers)
        found = candidates(chunk.read(copies), answers)
        codes, names, docs = _distinct([name for *_, name in found], [block.ids[doc] for block, doc, *_ in found])
        elsewhere = _told(names, parts, "window", answers)
        out, at = {b: [(0, len(b))] for b in copies if len(b) >= THRESHOLD}, 0
        for block, doc, pos, _ in found:
            own = codes[at : at + len(pos)]
            at += len(pos)
            hit = elsewhere[own] | (docs[own] < block.ids[doc])
            doc, pos = doc[hit], pos[hit]
            if len(pos):
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + THRESHOLD)]))
                last = np.concatenate([new[1:], [len(pos)]]) - 1
                for d, s, e in zip(doc[new].tolist(), pos[new].tolist(), (pos[last] + THRESHOLD).tolist(), strict=True):
                    out.setdefault(block.part[d][1], []).append((s - int(block.bases[d]), e - int(block.bases[d])))
        return out

    def finish(key: tuple, pdf: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            chunk = Chunk.of(pdf)
            gone = removed(chunk, _answers(made))
            for i, b in chunk.rows:
                spans = gone.get(b, [])
                if i > chunk.first[b] and len(b) >= THRESHOLD:
                    spans = [(0, len(b))]
                cuts = [0, *itertools.chain.from_iterable(spans), len(b)]
                kept = b"".join(b[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((None if i == NULL_ID else i, len(b), len(b) - len(kept), len(spans), sha256(kept).hexdigest(), np.array(spans, np.int64).reshape(-1).tolist()))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]).astype({"id": "Int64"})

    own = rows.mapInPandas(pack, PACKED).groupBy("c")
    texts = own.applyInPandas(send_texts, SENT).groupBy("part").applyInPandas(answer_texts, ANSWER)
    seeds = own.cogroup(texts.groupBy("c")).applyInPandas(send_seeds, SENT).groupBy("part").applyInPandas(answer_seeds, ANSWER)
    known = texts.unionByName(seeds)
    windows = own.cogroup(known.groupBy("c")).applyInPandas(send_windows, SENT).groupBy("part").applyInPandas(answer_windows, ANSWER)
    done = own.cogroup(known.unionByName(windows).groupBy("c"))
    return done.applyInPandas(finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>").withColumnRenamed("id", key)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
