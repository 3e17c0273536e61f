"""Toxicity (operator 10): nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Fit, on at most ``fit_rows`` labelled rows (those with the smallest hash of their id; the documented bound of the sample). A fifth of them is kept for calibration,
the others give the statistics; of these, at most ``index_rows`` are the examples of the index (the toxic ones up to half, then clean ones). Features are all
words of a text and their prefixes of 5 letters, as words are inflected and joined; a feature counts from two rows on, and what is left out
(features of one row, or of none) is one constant term. A vector is (1 + ln tf) * idf * relevance over all of a text's features, normed. Relevance is the
lift of a feature's toxic share over the base share, shrunk towards it for rare features, and never below ``floor``: no feature is dropped for its label.

The index holds the examples in blocks of 64 with each feature's greatest weight in a block. For every whole text the blocks' upper bounds order them, and the search
ends when no block left can enter the ``k`` nearest, which is exact. Votes weigh by (distance + 0.05) ** -2. An isotonic curve, fitted on the rows kept for
calibration, turns votes into a score: about that share of texts with such a vote is toxic. Evidence: ids and distances of the nearest examples.

Memory is bounded by ``fit_rows`` and ``index_rows`` on the driver and on each executor; texts are scored one by one where they lie, and nothing of a corpus is gathered.

Defined results: null, empty and feature-less texts have the constant term alone and are scored by the examples nearest to it; very long texts are scored whole; ties in
distance go by entry order (by id); repeated rows are scored each, equally; null labels and labels without a document are ignored; several labels of an id
count as the greatest; without any labelled row the score is 0; an empty table gives an empty table. Of extra columns all are passed on, but columns
named score, predicted or evidence are replaced by the results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import arrow_batches, materialize, table

BLOCK, OFTEN = 64, 16
PREFIX = 5
_WORD = re.compile(r"\w+")


def features_of(token: str) -> list[str]:
    """A token without white space: its words and their prefixes."""
    words = (token,) if token.isalnum() else _WORD.findall(token)
    return [f for w in words for f in ((w, w[:PREFIX] + "*") if len(w) > PREFIX else (w,))]


class _Known(dict):
    """Ids of the known features of a token; remembered, as most tokens come again."""

    def __init__(self, index: dict[str, int], most: int) -> None:
        self.index, self.most = index, most

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        got = self[token] = tuple(self.index[f] for f in features_of(token) if f in self.index)
        return got


class Features:
    """(ids, counts) of known features in a text."""

    def __init__(self, index: dict[str, int], remembered: int = 150_000) -> None:
        self.known = _Known(index, remembered)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = (text or "").lower().split()
        return np.unique(np.fromiter(chain.from_iterable(map(self.known.__getitem__, tokens)), np.int64), return_counts=True)


def unit(ids: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last term stands for what no feature holds and is in every text."""
    terms = np.append(ids, len(weights) - 1)
    raw = np.append(1 + np.log(counts), 1.0) * weights[terms]
    return terms, raw / np.sqrt(raw @ raw)


class BlockMaxIndex:
    """Examples (sparse unit vectors) as postings in blocks; ``nearest`` is exact. Terms that many examples have are kept as rows of one matrix, which is the same as postings but faster."""

    def __init__(self, size: int, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[tuple[int, int]]) -> None:
        """size: the number of terms; labels: for each vector whether it is toxic, and its id."""
        heavy = [max(zip(w.tolist(), t.tolist(), strict=True), default=(0.0, 0)) for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heavy[i][1], labels[i][1]))  # alike examples share blocks, which tightens their bounds
        self.labels = np.array([labels[i] for i in order], np.int64).reshape(-1, 2)
        self.blocks = max(1, -(-len(order) // BLOCK))
        entry = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.empty(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.empty(0)
        often = np.bincount(term, minlength=size) * OFTEN >= max(1, len(order))
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)  # of the matrix, or -1
        self.rows = np.zeros((int(often.sum()), self.blocks * BLOCK), np.float32)
        dense = often[term]
        self.rows[self.row[term[dense]], entry[dense]] = weight[dense]
        entry, term, weight = entry[~dense], term[~dense], weight[~dense]
        by = np.lexsort((entry, term))
        self.entry, self.weight = entry[by].astype(np.int32), weight[by].astype(np.float32)
        cell = term[by] * self.blocks + self.entry // BLOCK
        self.cut = np.searchsorted(cell, np.arange(size * self.blocks + 1)).astype(np.int32)  # where the postings of (term, block) start
        self.top = np.zeros(size * self.blocks, np.float32)
        np.maximum.at(self.top, cell, self.weight)
        self.top = self.top.reshape(size, self.blocks)

    def _scores(self, terms: np.ndarray, query: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """What the postings add to the cosines of all entries of the blocks, a row a block."""
        cells = terms[:, None] * self.blocks + blocks
        starts, sizes = self.cut[cells], self.cut[cells + 1] - self.cut[cells]
        flat = sizes.ravel()
        full = np.flatnonzero(flat)
        many = flat[full]
        at = np.repeat(starts.ravel()[full] - np.cumsum(many) + many, many) + np.arange(many.sum())
        row, col = full // len(blocks), full % len(blocks)
        place = np.repeat(col * BLOCK, many) + self.entry[at] % BLOCK
        return np.bincount(place, np.repeat(query[row], many) * self.weight[at], len(blocks) * BLOCK).reshape(-1, BLOCK)

    def nearest(self, terms: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, entries), best first, of the k nearest examples with a cosine over 0."""
        row = self.row[terms]
        known = (query[row >= 0].astype(np.float32) @ self.rows[row[row >= 0]]).astype(float).reshape(-1, BLOCK)
        terms, query = terms[row < 0], query[row < 0]
        bound = (known.max(axis=1) + query.astype(np.float32) @ self.top[terms]) * (1 + 1e-5)  # above what single precision may lose
        order = np.argsort(-bound, kind="stable")
        best, entries, done, step = np.empty(0), np.empty(0, np.int64), 0, 4
        while done < self.blocks:
            chosen = order[done : done + step]
            chosen = chosen[bound[chosen] >= best[k - 1]] if len(best) >= k else chosen[bound[chosen] > 0]
            if not len(chosen):
                break
            got = (known[chosen] + self._scores(terms, query, chosen)).ravel()
            of = (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            best, entries = np.concatenate([best, got[got > 0]]), np.concatenate([entries, of[got > 0]])
            first = np.lexsort((entries, -best))[:k]
            best, entries, done, step = best[first], entries[first], done + step, 2 * step
        return best, entries


def isotonic(votes: np.ndarray, labels: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (vote, share) of a rising curve: pooled adjacent violators, each pool with one row more of the base share."""
    pools: list[list[float]] = []  # rows, toxic ones, sum of votes
    for v, y in sorted(zip(votes.tolist(), labels.tolist(), strict=True)):
        pools.append([1.0, y, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, a, s = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + a, pools[-1][2] + s]
    x = np.array([s / n for n, _, s in pools])
    y = np.maximum.accumulate(np.array([(a + base) / (n + 1) for n, a, _ in pools]))
    return x, y


class Model:
    """The fitted index with its features and the curve from votes to scores."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, found: BlockMaxIndex, k: int) -> None:
        self.index, self.weights, self.found, self.k = index, weights, found, k
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def vote(self, ids: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        cosines, entries = self.found.nearest(*unit(ids, counts, self.weights), self.k)
        w = (np.maximum(0.0, 1 - cosines) + 0.05) ** -2
        return float(w @ self.found.labels[entries, 0] / w.sum()) if len(w) else 0.0, cosines, entries

    def score(self, vote: float) -> float:
        return vote if self.curve is None else float(np.interp(vote, *self.curve))


def relevance(toxic: Column, clean: Column, base: float, prior: float = 5.0, floor: float = 0.01, power: float = 1.5) -> Column:
    """The lift of a feature's toxic share over the base share, as if ``prior`` more rows of the base share had it."""
    lift = ((toxic + prior * base) / (toxic + clean + prior) - base) / max(1e-9, 1 - base)
    return F.greatest(F.lit(floor), F.pow(F.greatest(F.lit(0.0), lift), F.lit(power)))


def fit(examples: DataFrame, index_rows: int = 1_000, rest_weight: float = 1.0, k: int = 25, least_calibration: int = 20) -> Model:
    """examples: (key, text, label, part), bounded by the caller; part 0 calibrates. The driver gets the features of the index's examples and the examples as numbers."""
    from pyspark.sql import Window

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = (Counter(), Counter())
            for t, y in zip(pdf["text"], pdf["label"], strict=True):
                seen[y].update({f for token in set((t or "").lower().split()) for f in features_of(token)})
            keys = list(seen[0] | seen[1])
            if keys:
                yield pd.DataFrame({"f": keys, "clean": [seen[0][x] for x in keys], "toxic": [seen[1][x] for x in keys]})

    known = examples.where("part > 0")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = total.get(0, 0), total.get(1, 0)
    base = toxic / max(1, clean + toxic)
    least = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key")  # of at most fit_rows rows
    most = F.when(F.col("label") == 1, max(index_rows // 2, index_rows - clean)).otherwise(max(index_rows - toxic, index_rows // 2))
    chosen = materialize(known.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= most).select("key", "text", "label"), "index_examples")
    count = "f string, clean long, toxic long"
    both = F.col("a") + F.col("b")
    of_all = known.select("text", "label").mapInPandas(bags, count).groupBy("f").agg(F.sum("clean").cast("double").alias("b"), F.sum("toxic").cast("double").alias("a")).where(both >= 2)
    of_index = chosen.select("text", "label").mapInPandas(bags, count).select("f").distinct()
    rows = of_all.join(of_index, "f", "left_semi").select("f", (F.ln(1 + (clean + toxic) / both) * relevance(F.col("a"), F.col("b"), base)).alias("w")).toPandas()
    rows = rows.sort_values("f", ignore_index=True)
    index = {f: i for i, f in enumerate(rows["f"])}
    weights = np.append(rows["w"].to_numpy(float), rest_weight)
    names = examples.sparkSession.sparkContext.broadcast(index)  # bounded by index_rows

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Features(names.value)
        for pdf in batches:
            got = [counter(t) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "label": pdf["label"], "ids": [i.astype("<i4").tobytes() for i, _ in got], "n": [n.astype("<i4").tobytes() for _, n in got]})

    made = chosen.mapInPandas(vectors, "key long, label int, ids binary, n binary").toPandas().sort_values("key", ignore_index=True)
    read = lambda b: np.frombuffer(b, "<i4").astype(np.int64)
    units = [unit(read(i), read(n), weights) for i, n in zip(made["ids"], made["n"], strict=True)]
    model = Model(index, weights, BlockMaxIndex(len(weights), units, list(zip(made["label"].tolist(), made["key"].tolist(), strict=True))), k)
    kept = score_texts(examples.where("part = 0").select("label", "text"), model).select("label", "score").toPandas()
    if kept["label"].nunique() == 2 and len(kept) >= least_calibration:
        model.curve = isotonic(kept["score"].to_numpy(), kept["label"].to_numpy(), base)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label, part) of at most about ``fit_rows`` labelled ids outside the held-out fold, by the smallest hash of the id."""
    held = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0
    chosen = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held).groupBy(key).agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(fit_rows).select(F.col(key).cast("long").alias("key"), "label")
    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")  # fit_rows rows at most
    return found.select("key", "text", "label", F.pmod(F.xxhash64(F.lit("part"), F.col("key")), F.lit(5)).cast("int").alias("part"))


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, predicted and evidence (ids:distance of the five nearest examples)."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # bounded by index_rows

    @F.pandas_udf("struct<score:double,evidence:string>")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = handle.value
        counter, known = Features(model.index), {}
        for texts in batches:
            rows = []
            for t in texts:
                copy = blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if copy not in known:
                    if len(known) >= 10_000:
                        known.clear()
                    vote, cosines, entries = model.vote(*counter(t))
                    near = zip(model.found.labels[entries[:5], 1].tolist(), np.maximum(0.0, 1 - cosines[:5]).tolist(), strict=True)
                    known[copy] = model.score(vote), ",".join(f"{i}:{d:.4f}" for i, d in near)
                rows.append(known[copy])
            yield pd.DataFrame(rows, columns=["score", "evidence"])

    fresh = ("score", "predicted", "evidence")
    out = docs.select("*", rate(F.col(text)).alias("_rate")) if "_rate" not in docs.columns else docs.withColumn("_rate", rate(F.col(text)))
    kept = [c for c in docs.columns if c.lower() not in (*fresh, "_rate")]
    return out.select(*kept, F.col("_rate.score").alias("score"), (F.col("_rate.score") >= 0.5).cast("int").alias("predicted"), F.col("_rate.evidence").alias("evidence"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    with arrow_batches(spark):
        model = fit(materialize(training_rows(docs, table(spark, sf_dir, "labels")), "examples"))
        return materialize(score_texts(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "evidence"), "scores")
