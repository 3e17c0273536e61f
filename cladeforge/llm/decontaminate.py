"""Benchmark decontamination (operator 8): a distributed positional inverted index of the training tokens.

:class:`PositionalIndex` stores a lexicon and postings (term, row, pos) of a corpus, sorted by term within each file: of all words, or of the words of the benchmarks it
is made for. It is written once and serves any number of lookups, none of which reads a text again.

Each benchmark window (13 words in a row, or a whole shorter item) is looked up by its rarest terms: the index's counts choose the two rarest of its
positions, only these terms' postings are read, offset-adjusted to where the item would begin, and intersected: an alignment (row, item, begin) goes on if two
anchors of the item are posted there. The alignments left are verified word by word against the postings of the other terms, which gives exact phrase matches.
:meth:`Decontaminator.proximity` returns near ones: words in place up to a distance, from as many anchors a window as the asked share needs.

Everything is DataFrame expressions. A document is one row throughout, so a passage in a third of all rows is no hot key: keys are (row, item, begin) and (row, term, pos).
Texts are never shuffled. Tables of the benchmark are broadcast only while their written size is below ``BROADCAST_BYTES``; above, the same joins shuffle.

Words are lower-cased in A-Z only.

Defined results: null texts have no words and no hits; very long texts are indexed whole; items without words or with a null text are never found; items with equal
texts are found each; a null item id counts as an item and is left out of the ids; terms of equal counts (ties) go by position; repeated rows are rows of their own and get
equal results; empty tables give an empty table, or no hits. Extra columns stay out of the way, as only key, text and row are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import materialize, size_of, table, with_rows

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 8 << 20


def words_of(text: Column) -> Column:
    """Splitting on what is no word is several times faster than collecting words, as the class of separators is one of ASCII."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def sized(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast while it is small; else the join is the planner's choice."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df


class PositionalIndex:
    """lexicon: (word, term); postings: (term, row, pos), pos being the word's number in its row, from 0."""

    def __init__(self, lexicon: DataFrame, postings: DataFrame) -> None:
        self.lexicon, self.postings = lexicon, postings

    @classmethod
    def build(cls, docs: DataFrame, words: DataFrame | None = None, text: str = "text") -> PositionalIndex:
        """docs: with a column ``row`` that tells rows apart; words: (word), those to index, or None for all of the corpus."""
        posted = docs.select("row", F.posexplode(words_of(F.coalesce(F.col(text), F.lit("")))).alias("pos", "word"))
        lexicon = materialize((posted if words is None else words).select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "lexicon")
        postings = posted.join(sized(lexicon), "word").select("term", "row", "pos").sortWithinPartitions("term")
        return cls(lexicon, materialize(postings, "postings"))

    def save(self, path: str) -> None:
        self.lexicon.write.parquet(f"{path}/lexicon")
        self.postings.write.parquet(f"{path}/postings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PositionalIndex:
        return cls(spark.read.parquet(f"{path}/lexicon"), spark.read.parquet(f"{path}/postings"))


class Decontaminator:
    """The items (id, text) of a benchmark against the index of a corpus."""

    def __init__(self, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, index: PositionalIndex | None = None) -> None:
        """docs: with a column ``row`` (see :func:`with_rows`), or it is added. index: one of the same rows that knows the items' words; else one of these words is made."""
        self.window = window
        rows = docs if "row" in docs.columns and docs.schema["row"].dataType.typeName() == "struct" else with_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).withColumnsRenamed({"key": key, "text": text})
        self.docs = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), "row")
        known = items.select(F.col(item).alias("item"), words_of(F.coalesce(F.col(item_text), F.lit(""))).alias("words")).where(F.size("words") > 0)
        self.items = materialize(known.distinct().withColumn("item_key", F.monotonically_increasing_id()), "items")
        placed = self.items.select("item_key", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
        self.index = index or PositionalIndex.build(self.docs, placed.select("word"))
        self.item_terms = materialize(placed.join(sized(self.index.lexicon), "word", "left").select("item_key", "n", "at", "term"), "item_terms")

    def anchors(self, a_window: int) -> DataFrame:
        """(term, item_key, at, n): the ``a_window`` rarest positions of each window."""
        asked = self.item_terms.select("term").distinct()
        counts = self.index.postings.select("term").join(sized(self.item_terms).select("term").distinct(), "term", "left_semi").groupBy("term").count()
        counts = materialize(asked.join(counts, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("count")), "counts")
        rated = self.item_terms.join(sized(counts), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))  # words that the index does not know are the rarest
        per = rated.groupBy("item_key", "n").agg(F.sort_array(F.collect_list(F.struct("at", "count", "term"))).alias("all"))
        width = F.least("n", F.lit(self.window))
        rarest = lambda s: F.slice(F.sort_array(F.transform(F.slice("all", s, width), lambda x: F.struct(x["count"], x["at"], x["term"]))), 1, a_window)
        chosen = per.select("item_key", "n", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), rarest)))).alias("x"))
        return materialize(chosen.select("x.term", "item_key", "x.at", "n"), "anchors")

    def hits(self, a_window: int) -> DataFrame:
        """(row, item_key, n, at, begin): the anchors' postings, adjusted to where the item would begin."""
        met = self.index.postings.join(sized(self.anchors(a_window)), "term")
        return met.select("row", "item_key", "n", "at", (F.col("pos") - F.col("at")).alias("begin"))

    def verified(self, found: DataFrame, slop: int = 0) -> DataFrame:
        """(row, item_key, begin, n, ats) for each alignment (row, item_key, begin): the words of the item that the row has in place, or not more than ``slop`` words off."""
        wanted = found.join(sized(self.item_terms), "item_key").select("row", "item_key", "begin", "n", "at", "term", (F.col("begin") + F.col("at")).alias("place"))
        rows = materialize(found.select("row").distinct(), "rows_met")
        postings = self.index.postings.join(sized(rows), "row", "left_semi")
        if slop:
            there = postings.select("row", "term", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)).alias("place"))
        else:
            there = postings.select("row", "term", F.col("pos").alias("place"))
        return wanted.join(there, ["row", "term", "place"]).groupBy("row", "item_key", "begin", "n").agg(F.array_sort(F.collect_set("at")).alias("ats"))

    def phrase_hits(self) -> DataFrame:
        """(row, item, hits: positions of words inside occurring windows)."""
        # An anchor meets an alignment once, so two rows are two anchors.
        alignments = self.hits(2).groupBy("row", "item_key", "n", "begin").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= F.least("n", F.lit(2)))
        found = materialize(alignments.select("row", "item_key", "begin"), "alignments")
        width = F.least("n", F.lit(self.window))
        starts = F.filter("ats", lambda a, i: F.coalesce(F.get("ats", i + width - 1) == a + width - 1, F.lit(False)))
        hits = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(F.col("begin") + s, F.col("begin") + s + width - 1))))
        got = self.verified(found).select("row", "item_key", hits.alias("hits")).where(F.size("hits") > 0)
        return got.join(sized(self.items), "item_key").select("row", "item", "hits")

    def proximity(self, share: float = 0.8, slop: int = 0) -> DataFrame:
        """(row, item, begin, share): alignments at which at least that share of an item's words stands in place, or not more than ``slop`` words off.

        An item of n words may lack ``(1 - share) * n``; some window of it then lacks no more than ``(1 - share) * 2 * window``, as there are at least n / (2 * window) of them side by side.
        With two more anchors a window, two are posted within ``slop`` of the begin, so none is missed.
        Of begins that tell of one place (within twice ``slop``) the least is told.
        """
        near = self.hits(int((1 - share) * 2 * self.window + 1e-9) + 2)
        if slop:  # begins within 2 * slop share one of two neighbouring buckets
            wide = 2 * slop + 1
            near = near.select("row", "item_key", "n", "at", "begin", F.explode(F.array(F.floor(F.col("begin") / wide), F.floor(F.col("begin") / wide) + 1)).alias("bucket"))
        else:
            near = near.withColumn("bucket", F.col("begin"))
        found = near.groupBy("row", "item_key", "n", "bucket").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("begin").alias("begins"))
        found = found.where((F.col("lo") < F.col("hi")) | (F.col("n") == 1)).select("row", "item_key", F.explode("begins").alias("begin"))
        found = found.select("row", "item_key", F.explode(F.sequence(F.col("begin") - slop, F.col("begin") + slop)).alias("begin")).distinct()
        found = materialize(found, "near_alignments")
        got = self.verified(found, slop).select("row", "item_key", "begin", (F.size("ats") / F.col("n")).alias("share")).where(F.col("share") >= share)
        if slop:
            got = got.withColumn("place", F.floor(F.col("begin") / wide)).groupBy("row", "item_key", "place").agg(F.min(F.struct(-F.col("share"), "begin")).alias("best"))
            got = got.select("row", "item_key", F.col("best.begin").alias("begin"), (-F.col("best.col1")).alias("share"))
        return got.join(sized(self.items), "item_key").select("row", "item", "begin", "share")

    def report(self) -> DataFrame:
        """One row per document: key, n_words, n_hit, items (found ids, sorted as strings), n_items, row."""
        per_item = self.phrase_hits().groupBy("row", "item").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
        per_row = per_item.groupBy("row").agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
            F.count(F.lit(1)).alias("n_items"),
            F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
        )
        per_row = materialize(per_row, "hits")
        rows = self.docs.select("key", "row", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
        zero = F.lit(0).cast("long")
        return rows.join(per_row, "row", "left").select(
            "key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "row"
        )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Decontaminator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).report()
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)
), m AS (SELECT doc_id, item_id, s, k FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
