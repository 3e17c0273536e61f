"""Helpers shared by the operators: written cut points in the shared folder, identities of rows and skew-free row numbering."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local is a temporary folder made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="cladeforge-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def size_of(df: DataFrame) -> int:
    """The bytes of the tables and files that ``df`` reads; of a written table, its size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def in_few_files(df: DataFrame, size: int | None = None) -> DataFrame:
    """``df`` in about one task for each FILE_BYTES read, but two tasks a core at least, so that small tables are not written as many small files. It never splits a partition.

    Each new file costs a request to the store; Hadoop's local file system even starts a process for each, which for a moment counts as large as its executor.
    """
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, min(-(-(size_of(df) if size is None else size) // FILE_BYTES), 1 << 30)))


def materialize(df: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it again, so that lost executors lose nothing.

    size: the bytes to go by where much more is written than read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    in_few_files(df, size).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    atexit.register(_forget, spark, path)  # results that are still to be read depend on it until the driver ends
    return out


def with_rows(df: DataFrame, out: str = "row") -> DataFrame:
    """Adds ``out``: struct<file,at>, an identity of each row whatever its columns hold. What is not read from files is written first.

    ``at`` is the row's place in its file; files go by a hash, and that no two files share it is checked.
    """
    identity = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        named = df.select("*", identity.alias(out))
    except AnalysisException:
        df = materialize(df, "rows")
        named = df.select("*", identity.alias(out))
    paths = df.select(F.col("_metadata.file_path").alias("path")).distinct()
    if not paths.groupBy(F.xxhash64("path").alias("h")).count().where("count > 1").isEmpty():
        raise RuntimeError("two files share a hash; copy one under another name")
    return named


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the cluster may be gone already
        _delete(spark, path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While it lasts, Python workers get at most so many texts a batch, which bounds their memory; then the session's setting holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Deletes a table of :func:`materialize` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The array of ``values`` merged up to each place, by doubling offsets: n log n steps and no copy of the array for each element. No value may be null."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    back = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(rounds, values, lambda acc, k: F.transform(acc, lambda x, i: F.coalesce(merge(x, F.get(acc, i - back(k))), x)))


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 256) -> int:
    return max(least, -(-rows // per_bucket))


def salt(buckets: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Adds ``out``: gapless numbers from 0 within each group, a hot group being split over ``buckets`` tasks.

    Rows are hashed to buckets by ``order``; a bucket's first number is the count of the group's earlier buckets.
    ``df`` is read twice, so it should be cheap or materialized. Group columns must not be null.
    """
    df = df.withColumn("_bucket", salt(buckets, *order))
    keys = [*group, "_bucket"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket") if group else Window.orderBy("_bucket")
    starts = counts.withColumn("_start", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.join(starts, keys).withColumn(out, F.col("_start") + inside.cast("long") - 1).drop("_bucket", "_start")
