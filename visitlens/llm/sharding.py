"""Uniform shuffle into shards of exact size, planned by a hypergeometric communication matrix.

Every input partition permutes its rows locally. How many of its rows go to each shard is drawn beforehand from the
multivariate hypergeometric distribution, so shard sizes are exact without any central sort. The rows are exchanged by
that matrix and permuted again inside their shard. Only row counts per partition ever meet in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from visitlens.llm.common import let, uniform, written

POSITION_BITS = 33
ROWS_PER_BUCKET = 16_384
MATRIX_BYTES = 64 * 1024 * 1024


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """How many of `draws` items taken without replacement are good, by inversion of the uniform number `u`.

    The support is walked within 12 standard deviations and 20 of the mode; what lies outside has less mass than the
    smallest step between two doubles.
    """
    total = good + bad
    mean_part = draws.cast("double") * good / F.greatest(total, F.lit(1))  # the product of two counts may pass a long
    spread = F.sqrt(mean_part * bad / F.greatest(total, F.lit(1)) * (total - draws) / F.greatest(total - 1, F.lit(1)))
    mode = F.floor((draws + 1) * (good + 1).cast("double") / (total + 2))
    width = F.ceil(spread * 12 + 20)
    first = F.greatest(F.lit(0), draws - bad, mode - width).cast("long")
    last = F.least(good, draws, mode + width).cast("long")

    def ratio(k):
        return (good - k + 1).cast("double") * (draws - k + 1) / (k.cast("double") * (bad - draws + k))

    def walk(bounds):
        steps = F.when(bounds["last"] > bounds["first"], F.sequence(bounds["first"] + 1, bounds["last"])).otherwise(
            F.array().cast("array<bigint>"))
        mass = F.aggregate(
            steps, F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum")),
            lambda s, k: let(s["p"] * ratio(k), lambda p: F.struct(p.alias("p"), (s["sum"] + p).alias("sum"))),
            lambda s: s["sum"])
        return let(mass * u, lambda goal: F.aggregate(
            steps, F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), bounds["first"].alias("x")),
            lambda s, k: let(s["p"] * ratio(k), lambda p: F.struct(
                p.alias("p"), (s["sum"] + p).alias("sum"), (s["x"] + (s["sum"] <= goal).cast("long")).alias("x"))),
            lambda s: s["x"]))

    return let(F.struct(first.alias("first"), last.alias("last")), walk)


def multivariate_hypergeometric(room: Column, draws: Column, *seed: Column) -> Column:
    """How many of `draws` items fall to each colour, `room` holding the number of items of every colour."""
    start = F.struct(
        draws.cast("long").alias("left"), F.aggregate(room, F.lit(0).cast("long"), lambda a, b: a + b).alias("pool"),
        F.array().cast("array<bigint>").alias("out"))

    def step(s, j):
        good = F.get(room, j)
        taken = hypergeometric(uniform(*seed, j), good, s["pool"] - good, s["left"])
        return let(taken, lambda x: F.struct(
            (s["left"] - x).alias("left"), (s["pool"] - good).alias("pool"), F.concat(s["out"], F.array(x)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, step, lambda s: s["out"])


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows each block sends to each shard: `block`, `sends` (array of `shards` counts), from `block`, `n`.

    Blocks are halved again and again. Each half draws its share of the room its parent has in every shard, which gives
    the same distribution as dealing out a uniform permutation of all rows.
    """
    blocks, rows = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    room = F.array(*[F.lit(rows // shards + (j < rows % shards)).cast("long") for j in range(shards)])
    nodes = counts.agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("blocks")).select(
        "blocks", room.alias("room"))
    for level in range(max(1, math.ceil(math.log2(max(blocks, 2))))):
        if level == 6:
            nodes = nodes.repartition(F.get("blocks", F.lit(0))["block"])
        half = F.floor(F.size("blocks") / 2).cast("int")
        nodes = nodes.filter(F.size("blocks") > 0).select(
            F.slice("blocks", F.lit(1), half).alias("low"),
            F.slice("blocks", half + 1, F.size("blocks") - half).alias("high"), "room")
        drawn = multivariate_hypergeometric(
            F.col("room"), F.aggregate("low", F.lit(0).cast("long"), lambda a, b: a + b["n"]),
            F.lit(seed), F.lit(level), F.get("high", F.lit(0))["block"])
        nodes = nodes.withColumn("drawn", drawn).select(F.inline(F.array(
            F.struct(F.col("low").alias("blocks"), F.col("drawn").alias("room")),
            F.struct(F.col("high").alias("blocks"), F.zip_with("room", "drawn", lambda a, b: a - b).alias("room"))))
        ).filter(F.size("blocks") > 0)
    return nodes.select(F.get("blocks", F.lit(0))["block"].alias("block"), F.col("room").alias("sends"))


def shuffle_to_shards(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """`docs` with `shard` (0 … shards - 1) and `slot` (gapless from 0 in each shard): a uniform random permutation.

    Shard sizes are at most one apart. Rows are told apart by where they lie, so nulls, empty texts, ties and repeated
    rows are placed like any other row; an empty table stays empty. All other columns are kept; columns of the input
    named `shard` or `slot` are replaced.
    """
    spark = docs.sparkSession
    partition_key = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    # The local permutation is written down with the rows: later jobs may split the table in other ways.
    copy = written(
        docs.select(F.struct("*").alias("row"), partition_key.alias("key")).sortWithinPartitions("key")
        .select("row", F.monotonically_increasing_id().alias("at")))
    block = F.shiftright("at", POSITION_BITS)
    counts = copy.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    matrix = written(communication_matrix(counts, shards, seed))
    blocks, rows = matrix.agg(F.count("*"), F.coalesce(
        F.sum(F.aggregate("sends", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()
    if blocks * shards * 8 <= MATRIX_BYTES:
        matrix = F.broadcast(matrix)

    ends = F.aggregate(
        "sends", F.array().cast("array<bigint>"),
        lambda a, n: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long")) + n)))
    matrix = matrix.select("block", ends.alias("ends"))
    position = F.col("at").bitwiseAND((1 << POSITION_BITS) - 1)
    wanted = max(rows / shards / ROWS_PER_BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions")) / shards)
    bits = max(0, math.ceil(math.log2(max(wanted, 1))))
    order = F.xxhash64(F.lit(seed + 1), F.col("at"))
    placed = copy.withColumn("block", block).join(matrix, "block").select(
        "row", "at", F.size(F.filter("ends", lambda end: end <= position)).alias("shard"), order.alias("order"),
        (F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long")).alias("bucket"))

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("order", "at")
    numbered = placed.withColumn("rank", F.row_number().over(inside)).join(starts, ["shard", "bucket"])
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return numbered.select(*kept, "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))
