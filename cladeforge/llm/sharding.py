"""Sharding (operator 2): balanced label propagation under capacity quotas.

Documents with equal texts are linked. Counts per (group, shard) are the whole state, as linked documents of one shard are alike: a hot
group is as many rows as there are shards. In each round a group's part in one shard asks to move to the group's largest part in a shard with
room (ties: the shard with more room), larger gains first, as far as that shard's room goes; the rest stays. Rounds end when nothing moves.
Documents without links then fill every shard up to its exact number of rows (law ``rows``: counts at most one apart).

Everything is DataFrame expressions. Members of a group, free documents, arrivals and slots are numbered in buckets that grow in number with the table, never
in one task for a group or a shard. The driver holds one number per shard.

Defined results: null texts count 0 bytes and are linked to each other and to no other text; repeated rows are each placed; null ids are kept; an empty
table gives an empty table. Extra columns stay out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeforge.llm.common import buckets_for, discard, materialize, number_rows, salt, table

SHARDS = 40


def _lookup(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)


def prefix_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over a group's rows before this one, in two levels. ``order`` starts with a small integer that ranks first."""
    df = df.withColumn("_bucket", salt(buckets, *order))
    keys = [*group, order[0], "_bucket"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(order[0], "_bucket")
    starts = sums.withColumn("_start", F.sum("_sum").over(before) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, keys).withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_start")


def propagate(state: DataFrame, capacity: list[int], buckets: int, max_rounds: int | None = None) -> DataFrame:
    """state: (h, shard, c), materialized, with no shard above its capacity. Returns the state at which nothing moves.

    All parts of a group ask for one shard a round, that of its largest part with room, so each move makes the sum of squared counts larger and the
    rounds end. A group alone needs a round a shard at most; ``max_rounds`` (shards * (groups + shards) if not given) only guards, and raises if met.
    """
    shards, done = len(capacity), 0
    if max_rounds is None:
        max_rounds = shards * (state.select("h").distinct().count() + shards)
    while True:
        load = {r["shard"]: r["c"] for r in state.groupBy("shard").agg(F.sum("c").alias("c")).collect()}  # one row a shard
        room = [capacity[s] - load.get(s, 0) for s in range(shards)]
        order = {s: i for i, s in enumerate(sorted(range(shards), key=lambda s: (room[s], -s)))}
        place = _lookup([order[s] for s in range(shards)], F.col("shard"))
        parts = state.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("c", place.alias("p"), F.col("shard").alias("s"))), asc=False).alias("parts"))  # a row a shard
        parts = parts.where(F.size("parts") > 1)
        asks = parts.select("h", F.explode("parts").alias("own"), "parts")
        larger = F.filter("parts", lambda p: (p > F.col("own")) & (_lookup(room, p["s"]) > 0))
        asks = asks.select("h", F.col("own.c").alias("c"), F.col("own.s").alias("shard"), F.get(larger, F.lit(0)).alias("best")).where("best is not null")
        asks = asks.select("h", "shard", "c", F.col("best.s").alias("to"), (-F.floor(F.log2("best.c"))).cast("int").alias("rank"))
        ranked = prefix_sum(materialize(asks, "asks"), ["to"], ["rank", "h", "shard"], "c", "before", buckets)
        moves = ranked.withColumn("m", F.least(F.col("c"), _lookup(room, F.col("to")) - F.col("before"))).where("m > 0")
        moves = materialize(moves.select("h", "shard", "to", "m"), "moves")
        if moves.isEmpty():
            discard(moves)
            return state
        if done == max_rounds:
            raise RuntimeError(f"shards have not settled after {max_rounds} rounds")
        deltas = moves.select("h", "shard", (-F.col("m")).alias("c")).unionByName(moves.select("h", F.col("to").alias("shard"), F.col("m").alias("c")))
        new = materialize(state.unionByName(deltas).groupBy("h", "shard").agg(F.sum("c").alias("c")).where("c > 0"), "state")
        discard(state)
        discard(moves)
        state, done = new, done + 1


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, max_rounds: int | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot): every shard gets floor or ceil of rows / shards; equal texts are kept together as far as quotas allow."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(key).alias("key"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"), crc.alias("text_crc32"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null")).alias("h")
    )
    rows = materialize(rows, "rows")
    n = rows.count()
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    buckets = buckets_for(n)
    rows = rows.withColumn("bucket", salt(buckets, "key", "h"))
    per = rows.groupBy("h", "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("h")  # a row a bucket at most
    per = per.withColumn("total", F.sum("n").over(whole)).where("total > 1").withColumn("start", F.sum("n").over(whole.orderBy("bucket")) - F.col("n"))
    per = materialize(per, "groups")
    linked = rows.join(per, ["h", "bucket"], "left")
    inside = F.row_number().over(Window.partitionBy("h", "bucket").orderBy("key", "text_crc32")) - 1
    linked = materialize(linked.withColumn("rank", F.when(F.col("total").isNotNull(), F.col("start") + inside)).drop("n", "total", "start"), "linked")
    # Where a linked document is at first: its number among all linked ones, modulo the shards, which is below every capacity.
    groups = linked.where("rank is not null")
    first = number_rows(groups.select("key", "h", "rank"), [], ["h", "rank"], "at", buckets)
    state = materialize(first.groupBy("h", (F.col("at") % shards).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("c")), "state")
    state = propagate(state, capacity, buckets, max_rounds)
    slots = prefix_sum(state.withColumn("_one", F.lit(0)), ["shard"], ["_one", "h"], "c", "slot_base", buckets)
    slots = materialize(slots.select("h", "shard", "c", "slot_base"), "slots")
    filled = {r["shard"]: r["c"] for r in slots.groupBy("shard").agg(F.sum("c").alias("c")).collect()}
    pieces = slots.withColumn("lo", F.sum("c").over(Window.partitionBy("h").orderBy("shard")) - F.col("c"))
    pieces = pieces.groupBy("h").agg(F.collect_list(F.struct("lo", "c", "shard", "slot_base")).alias("pieces"))
    spread = per.select("h", "bucket").join(pieces, "h")
    mine = F.get(F.filter("pieces", lambda p: (F.col("rank") >= p["lo"]) & (F.col("rank") < p["lo"] + p["c"])), F.lit(0))
    placed = groups.join(spread, ["h", "bucket"]).withColumn("p", mine)
    placed = placed.select("key", "size", "text_crc32", F.col("p.shard").alias("shard"), (F.col("p.slot_base") + F.col("rank") - F.col("p.lo")).alias("slot"))
    starts, at = [], 0
    for s in range(shards):
        starts.append(at)
        at += capacity[s] - filled.get(s, 0)
    free = number_rows(linked.where("rank is null").select("key", "size", "text_crc32", "h"), [], ["key", "h"], "at", buckets)
    where = F.array(*[F.lit(x).cast("long") for x in starts])
    shard = (F.size(F.filter(where, lambda s: s <= F.col("at"))) - 1).cast("int")
    free = free.withColumn("shard", shard)
    slot = F.col("at") - _lookup(starts, F.col("shard")) + _lookup([filled.get(s, 0) for s in range(shards)], F.col("shard"))
    return placed.unionByName(free.select("key", "size", "text_crc32", "shard", slot.alias("slot")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard_documents(table(spark, sf_dir, "documents"))
    return made.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
