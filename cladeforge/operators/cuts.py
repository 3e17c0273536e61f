"""Cut points for iterated plans: tables written to the folder that the driver and all executors share, and chains of ancestors made with them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master without that setting gets a temporary one, which goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix=f"cladeforge-{name}-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, in no more files than two a core: its lineage ends there, and lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name)
    df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chains(rows: DataFrame, key: str, parent: str, item: Column, out: str) -> DataFrame:
    """(key, out): the items of a row's ancestors from the root down, and its own last.

    Chains double in each round, so a tree of any depth takes the logarithm of its depth in joins. Rows on a cycle or below an unknown parent have no root and are left out.
    """
    own = F.when(F.col(parent) == F.col(key), None).otherwise(F.col(parent))
    state = cut(rows.select(F.col(key).alias("_id"), own.alias("_above"), F.array(F.struct(F.col(key).alias("id"), item.alias("item"))).alias("_chain")), "chains")
    while not state.where("_above is not null").isEmpty():
        other = state.select(F.col("_id").alias("_above"), F.col("_chain").alias("_front"), F.col("_above").alias("_next"))
        met = state.join(other, "_above", "left").where("_above is null or _front is not null")
        met = met.select("_id", F.col("_next").alias("_above"), F.when(F.col("_front").isNull(), F.col("_chain")).otherwise(F.concat("_front", "_chain")).alias("_chain"))
        ids = F.transform("_chain", lambda x: x["id"])
        state = cut(met.where(F.size(F.array_distinct(ids)) == F.size(ids)), "chains")
    return state.select(F.col("_id").alias(key), F.transform("_chain", lambda x: x["item"]).alias(out))
