"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

toxicity: documents scored as toxic go. near_dedup: of each group of SimHash near-duplicates one document stays, that with the smallest id. decontamination: documents
contaminated with benchmark passages go. secrets: secrets in the texts are replaced by a mark. packing: what is left is packed into sequences; its rows are the
pieces and their places.

Rows are told apart by their place in the stage's input, not by their columns, so nothing is lost or dropped for sharing an id, or an id and a text, with another row.

Defined results: null and empty texts are scored like any text without known words, share the fingerprint 0 and so leave one document between them, have no words, no secrets and one token;
documents without an id take part in all stages and stay in a group of near-duplicates only if none of it has an id; ties (equal least ids, repeated rows) leave the row that comes first in the
stage's input; unrelated texts under one id are kept each; very long texts are read whole; an empty table gives an empty table; columns other than those of ``documents`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.llm import decontaminate, packing, secrets, simhash, toxicity
from cladeforge.llm.common import arrow_batches, materialize, table, with_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_rows(docs.select(*COLUMNS))
    with arrow_batches(spark):
        model = toxicity.fit(materialize(toxicity.training_rows(docs, table(spark, sf_dir, "labels")), "examples"))
        toxic = materialize(toxicity.score_texts(rows.select("row", "text"), model).where("predicted = 1").select("row"), "toxic")
    return without(rows, toxic)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest id stays, then the first one; only names of rows are compared and shuffled."""
    rows = with_rows(docs.select(*COLUMNS))
    found = materialize(simhash.classes(rows, carry=("row",)).select("component", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("own")), "classes")
    first = found.groupBy("component").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "first")
    gone = materialize(found.join(first, "component").where("own <> first").select("own.row"), "copies")
    return without(rows, gone)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows but for those in ``gone``, a written table: broadcast while it is small, else texts are shuffled once."""
    return rows.join(decontaminate.sized(gone), "row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_rows(docs.select(*COLUMNS))
    found = decontaminate.Decontaminator(rows, table(spark, sf_dir, "benchmark")).report()
    bad = materialize(found.where(decontaminate.contaminated()).select("row"), "contaminated")
    return without(rows, bad)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    rows = docs.select(F.struct("doc_id", *rest).alias("own"), "text")
    found = secrets.scan(rows, key="own", text="text")
    clean = found.select("key", secrets.redact(F.col("text"), F.col("found")).alias("text"), F.size("found").alias("n"))
    return clean.select(F.col("key.doc_id").alias("doc_id"), "text", F.col("key.lang").alias("lang"), F.col("key.source").alias("source"), F.when(F.col("n") > 0, F.length("text").cast("long")).otherwise(F.col("key.n_chars")).alias("n_chars"))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_rest),
]

#: Fingerprints, components and tokens are not for SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
