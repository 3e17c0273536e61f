"""Analytics around profiles: histograms, weighted percentiles, log-ratios, accuracy, batches, logs, simulated reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.functions import kmers, names


def node_histogram(raw: DataFrame) -> DataFrame:
    """(classified, node, cnt): k-mers a node got, from rows with a hits text, for reads of code C and others."""
    hits = raw.where("code <> 'U' and hits <> ''").select((F.col("code") == "C").alias("classified"), F.explode(F.split("hits", " ")).alias("h"))
    return hits.select("classified", names.parse_hit("h").alias("x")).groupBy("classified", F.col("x.node").alias("node")).agg(F.sum("x.cnt").alias("cnt"))


def weighted_percentiles(df: DataFrame, value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """(q, value): a value stands at the middle of its weight in the running sum, as a share of all; between two values it is interpolated, outside it is the least or greatest one.

    Equal values are one row first. The sum runs in ranges of values that are cut at quantiles, so no task has all of them."""
    sums = df.groupBy(F.col(value).cast("double").alias("x")).agg(F.sum(weight).cast("double").alias("w"))
    cuts = sums.agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 1000).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("x")))
    placed = sums.withColumn("part", part)
    per = placed.groupBy("part").agg(F.sum("w").alias("pw"))  # 64 rows at most
    before = per.select("part", (F.sum("pw").over(Window.orderBy("part")) - F.col("pw")).alias("base"), F.sum("pw").over(Window.partitionBy()).alias("total"))
    inside = F.sum("w").over(Window.partitionBy("part").orderBy("x"))
    at = placed.join(before, "part").withColumn("at", (F.col("base") + inside - F.col("w") / 2) / F.col("total"))
    rows = at.select("x", "at", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    ends = rows.groupBy("q").agg(
        F.max(F.when(F.col("at") <= F.col("q"), F.struct("at", "x"))).alias("lo"), F.min(F.when(F.col("at") >= F.col("q"), F.struct("at", "x"))).alias("hi")
    )
    lo, hi = F.col("lo"), F.col("hi")
    between = lo["x"] + (hi["x"] - lo["x"]) * (F.col("q") - lo["at"]) / F.nullif(hi["at"] - lo["at"], F.lit(0.0))
    return ends.select("q", F.coalesce(between, lo["x"], hi["x"]).alias("value"))


def bin_count(df: DataFrame, value: str, weight: str) -> DataFrame:
    """(width, bins): bins as wide as the weighted interquartile range over the cube root of the number of values, and how many of them span the values."""
    q = weighted_percentiles(df, value, weight, [0.25, 0.75]).agg(F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q25"), F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q75"))
    own = df.agg(F.count_distinct(F.col(value)).alias("n"), F.max(value).cast("double").alias("hi"), F.min(value).cast("double").alias("lo"))
    width = (F.col("q75") - F.col("q25")) / F.cbrt("n")
    return q.join(own).select(width.alias("width"), F.bround((F.col("hi") - F.col("lo")) / F.nullif(width, F.lit(0.0))).cast("long").alias("bins"))  # one row each


def save_histograms(found: DataFrame, path: str) -> None:
    """Two folders of lines node,count in order of nodes: classified reads and split ones, as :func:`node_histogram` has them."""
    for name, flag in (("c_counts", True), ("s_counts", False)):
        found.where(F.col("classified") == flag).select("node", "cnt").orderBy("node").coalesce(1).write.mode("overwrite").csv(f"{path}/{name}")


def load_histograms(spark: SparkSession, path: str) -> DataFrame:
    read = lambda name, flag: spark.read.schema("node int, cnt bigint").csv(f"{path}/{name}").select(F.lit(flag).alias("classified"), "node", "cnt")
    return read("c_counts", True).unionByName(read("s_counts", False))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return df.where(F.col(value).between(low, high)).groupBy(F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_ratio(counts: DataFrame, offset: int = 1) -> DataFrame:
    """(sample, node, clr): log2(count + offset) less the sample's mean of it."""
    x = F.log2(F.col("cnt") + offset)
    return counts.withColumn("_x", x).select("sample", "node", F.round(F.col("_x") - F.avg("_x").over(Window.partitionBy("sample")), 9).alias("clr"))


def per_million(counts: DataFrame) -> DataFrame:
    return counts.withColumn("cpm", F.round(F.col("cnt") * 1e6 / F.sum("cnt").over(Window.partitionBy("sample")), 6))


def precision_recall(pred: DataFrame, truth: Column, made: Column, positive) -> DataFrame:
    hit, said, real = (made == positive) & (truth == positive), made == positive, truth == positive
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return pred.agg(n(hit).alias("hits"), F.round(n(hit) / n(said), 9).alias("precision"), F.round(n(hit) / n(real), 9).alias("recall"))


def merge_batches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join of two batches' tables; missing cells are 0."""
    return a.join(b, key, "full").na.fill(0)


def greedy_batches(df: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """(group, order, batch): a new batch begins where the running size would pass the limit. A fold over a group's ordered files."""
    state = "struct<batch:int,sum:bigint,out:array<int>>"
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("s")))).alias("rows"))
    first = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        over = (acc["sum"] > 0) & (acc["sum"] + x["s"] > limit)
        batch = acc["batch"] + F.when(over, 1).otherwise(0)
        return F.struct(batch.alias("batch"), (F.when(over, F.lit(0).cast("bigint")).otherwise(acc["sum"]) + x["s"]).alias("sum"), F.concat(acc["out"], F.array(batch)).alias("out")).cast(state)

    done = rows.withColumn("b", F.aggregate("rows", first, step)["out"])
    return done.select(group, F.explode(F.arrays_zip("rows", "b")).alias("z")).select(group, F.col("z.rows.o").alias(order), F.col("z.b").alias("batch"))


def read_log(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.withColumns({"at": names.log_time(line), "took": names.log_took(line), "rss": names.log_memory(line, "RSS"), "vsz": names.log_memory(line, "VSZ")})


def job_memory(log: DataFrame) -> DataFrame:
    """(job, rss, vsz): the last figures of each process, summed by job."""
    last = log.groupBy("job", "pid").agg(F.max_by("rss", "at").alias("rss"), F.max_by("vsz", "at").alias("vsz"))
    return last.groupBy("job").agg(F.round(F.sum("rss"), 6).alias("rss"), F.round(F.sum("vsz"), 6).alias("vsz"))


def simulate_reads(genomes: DataFrame, per_genome: int, length: int, error_every: int = 0, longest_gap: int = 75) -> DataFrame:
    """(node_id, i, seq, mate): starts from a hash of genome and number, so any run gives the same reads. Reads with ``longest_gap`` N in a row go;
    every ``error_every``-th read has one base replaced by its complement."""
    room = F.length("seq") - length + 1
    drawn = genomes.where(room > 0).select("node_id", "seq", room.alias("room"), F.explode(F.sequence(F.lit(0), F.lit(per_genome - 1))).alias("i"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit("read"), F.col("node_id").cast("string"), F.col("i").cast("string"))), 1, 12), 16, 10).cast("bigint")
    reads = drawn.withColumn("s", F.substring("seq", (draw % F.col("room")).cast("int") + 1, F.lit(length)))
    if error_every:
        at = (F.col("i") % length).cast("int") + 1
        changed = F.concat(F.substring("s", F.lit(1), at - 1), F.translate(F.substring("s", at, F.lit(1)), "ACGT", "TGCA"), F.substring("s", at + 1, F.lit(length)))
        reads = reads.withColumn("s", F.when(F.col("i") % error_every == 0, changed).otherwise(F.col("s")))
    reads = reads.where(~F.contains(F.col("s"), F.repeat(F.lit("N"), longest_gap)))
    return reads.select("node_id", "i", F.col("s").alias("seq"), kmers.reverse_complement("s").alias("mate"))


def any_in_window(df: DataFrame, group: str, order: str, flag: Column, width: int) -> DataFrame:
    return df.withColumn("any", F.max(flag.cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(0, width - 1)))


def runs(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, run, value, n): runs of equal values in order."""
    w = Window.partitionBy(group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).groupBy(group, "run", value).agg(F.count(F.lit(1)).alias("n"))
