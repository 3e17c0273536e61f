"""Reads as a stream: the same stream-static lookup and vote as in batch, and counts kept up by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeforge.operators import classify, results


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of (sample, read_id, seq) as they arrive."""
    return spark.readStream.schema("sample string, read_id string, seq string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def classify_stream(reads: DataFrame, table: DataFrame, nodes: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, alpha: float = classify.ALPHA) -> StreamingQuery:
    """Each micro-batch is classified whole, since a read's k-mers are all in one row; ``sink`` gets read results. No state is kept."""
    def batch(rows: DataFrame, epoch: int) -> None:
        hits = classify.look_up(classify.read_kmers(rows, k), table)
        sink(classify.vote(hits, nodes, alpha), epoch)

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Counts of each batch in a folder of its own, so that a repeated batch replaces its own counts only; sums are made when read."""

    def sink(result: DataFrame, epoch: int) -> None:
        results.counts(result).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return sink


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.parquet(folder)
    return found.groupBy("sample", "node").agg(F.sum("sl").cast("bigint").alias("sl"), F.sum("ml").cast("bigint").alias("ml"))
