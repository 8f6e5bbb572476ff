"""A uniform shuffle into shards of exact sizes, by a communication matrix.

Blocks are the partitions in which the rows arrive. How many rows each block sends to each shard is drawn first: the
matrix has the law of a uniform random permutation (a multivariate hypergeometric one). Rows are then permuted within
their block, dealt out by the matrix, exchanged, and permuted again within their shard. Everything is DataFrame
operations; draws are keyed hashes, so a lost task gives the same rows when it runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulemill.functions.columns import column, let
from rulemill.llm.common import unsigned, written

#: Rows that one task permutes in the second permutation, on average.
BUCKET_ROWS = 50_000


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `drawn` rows are marked, if `marked` of `total` are, for a uniform number in [0, 1).

    Inversion from the mode: weights relative to the mode's follow from their ratios, upwards and then downwards. The walk
    covers 40 standard deviations and 40 steps to either side; what lies beyond has less weight than a double can hold.
    """

    def draw(p: Column) -> Column:
        total, marked, drawn, mode, low, high = (p[c] for c in ("total", "marked", "drawn", "mode", "low", "high"))
        share = marked / total
        reach = (F.lit(40) + 40 * F.sqrt(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1.0)))).cast("long")
        up, down = F.least(reach, (high - mode).cast("long")), F.least(reach, (mode - low).cast("long"))
        start = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"), mode.alias("at"), F.lit(None).cast("double").alias("pick"))

        def step(goal: Column | None):
            def move(s: Column, i: Column) -> Column:
                # 1..up climbs, 0 returns to the mode, -1..-down descends
                x, rest = s["at"], total - marked - drawn
                climb = (marked - x) * (drawn - x) / ((x + 1) * (rest + x + 1))
                sink = x * (rest + x) / ((marked - x + 1) * (drawn - x + 1))
                weight = F.when(i == 0, F.lit(1.0)).otherwise(s["weight"] * F.when(i > 0, climb).otherwise(sink))
                at = F.when(i == 0, mode).when(i > 0, x + 1).otherwise(x - 1)
                total_weight = F.when(i == 0, s["sum"]).otherwise(s["sum"] + weight)
                pick = s["pick"] if goal is None else F.when(s["pick"].isNull() & (i != 0) & (total_weight > goal), at).otherwise(s["pick"])
                return F.struct(weight.alias("weight"), total_weight.alias("sum"), at.alias("at"), pick.alias("pick"))

            return move

        path = F.concat(
            F.when(up > 0, F.sequence(F.lit(1).cast("long"), up)).otherwise(F.array().cast("array<long>")),
            F.sequence(F.lit(0).cast("long"), -down),
        )
        weigh = lambda steps: F.aggregate(steps, start, step(None), lambda s: s["sum"])
        choose = lambda steps, goal: F.aggregate(steps, start, step(goal), lambda s: F.coalesce(s["pick"], mode))
        return let(path, lambda steps: let(weigh(steps) * uniform, lambda goal: F.when(goal < 1, mode).otherwise(choose(steps, goal))))

    double = lambda c: c.cast("double")
    low, high = F.greatest(F.lit(0.0), double(drawn) + double(marked) - double(total)), F.least(double(drawn), double(marked))
    mode = F.least(high, F.greatest(low, F.floor((double(drawn) + 1) * (double(marked) + 1) / (double(total) + 2)).cast("double")))
    pack = F.struct(double(total).alias("total"), double(marked).alias("marked"), double(drawn).alias("drawn"), mode.alias("mode"), low.alias("low"), high.alias("high"))
    return F.when(low >= high, low).otherwise(let(pack, draw)).cast("long")


def _deal(room: Column, size: Column, seed: int, *key: Column) -> Column:
    """Counts per shard for `size` rows drawn without replacement where `room` rows are left per shard."""
    start = F.struct(
        F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), size.alias("size"), F.array().cast("array<long>").alias("counts")
    )

    def one(state: Column, place: Column) -> Column:
        n = hypergeometric(state["total"], place["room"], state["size"], unsigned(F.xxhash64(F.lit(seed), *key, place["shard"])))
        return let(
            n,
            lambda n: F.struct(
                (state["total"] - place["room"]).alias("total"), (state["size"] - n).alias("size"), F.concat(state["counts"], F.array(n)).alias("counts")
            ),
        )

    places = F.transform(room, lambda r, i: F.struct(r.alias("room"), i.alias("shard")))
    return F.aggregate(places, start, one, lambda s: s["counts"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(block, n) -> (block, counts): rows that each block sends to each shard; shard sizes differ by one at most.

    Blocks are halved again and again. The left half of a group draws its counts from the room of the group, the right half
    keeps the rest, so a level of the tree is independent work for each group. A group carries the list of its block sizes,
    which is as long as the number of input partitions.
    """
    blocks = F.array_sort(F.collect_list(F.struct("block", F.col("n").cast("long").alias("n"))))
    whole = sizes.agg(blocks.alias("blocks")).filter(F.size("blocks") > 0)
    rows = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    base, extra = F.floor(rows / shards).cast("long"), rows % shards
    level = whole.withColumn("room", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: base + F.when(s < extra, 1).otherwise(0)))
    depth = max(0, (max(1, sizes.count()) - 1).bit_length())
    for k in range(depth):
        half = F.ceil(F.size("blocks") / 2).cast("int")
        level = level.withColumn("left", F.slice("blocks", F.lit(1), half)).withColumn("right", F.slice("blocks", half + 1, F.size("blocks")))
        drawn = F.aggregate("left", F.lit(0).cast("long"), lambda a, b: a + b["n"])
        level = level.withColumn("sent", _deal(F.col("room"), drawn, seed, F.lit(k), F.get("left", F.lit(0))["block"]))
        rest = F.zip_with("room", "sent", lambda r, s: r - s)
        level = level.select(F.explode(F.array(F.struct(F.col("left").alias("blocks"), F.col("sent").alias("room")), F.struct(F.col("right").alias("blocks"), rest.alias("room")))).alias("g"))
        level = level.select("g.*").filter(F.size("blocks") > 0)
        if k % 4 == 3:  # spread the groups, and cut the growing plan
            level = written(level.repartition(min(200, 1 << (k + 1)), F.get("blocks", F.lit(0))["block"]), "sharding-matrix")
    return level.select(F.get("blocks", F.lit(0))["block"].alias("block"), F.col("room").alias("counts"))


def shard_rows(df: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard): a uniform random permutation of all rows.

    Shard sizes differ by one at most. Rows are told apart by their place in the input, not by a key, so repeated rows, ties
    and NULLs are rows like others. Input columns named `shard` or `slot` are replaced; other names may clash with nothing,
    as the row travels in one struct. An empty table gives an empty result; with more shards than rows some stay empty.

    The input with its places is written to the shared folder once, because places must not change between two readings.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    placed = df.select(F.struct(*map(column, kept)).alias("row"), F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place"))
    placed = written(placed, "sharding-rows")
    sizes = written(placed.groupBy("block").agg(F.count("*").alias("n")), "sharding-sizes")
    rows = sizes.agg(F.sum("n")).first()[0] or 0

    matrix = communication_matrix(sizes, shards, seed).withColumn("ends", F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x)))
    first = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "place"), "place")
    dealt = placed.withColumn("rank", F.row_number().over(first)).join(written(matrix.select("block", "ends"), "sharding-ends"), "block")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))

    buckets = max(1, -(-rows // (shards * bucket_rows)))
    draw = F.xxhash64(F.lit(seed), F.lit("shard"), "place")
    dealt = written(dealt.select("row", "place", "shard", F.pmod(draw, F.lit(buckets)).cast("int").alias("bucket")), "sharding-dealt")
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    second = Window.partitionBy("shard", "bucket").orderBy(draw, "place")
    out = dealt.withColumn("rank", F.row_number().over(second)).join(starts, ["shard", "bucket"])
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.col("shard").cast("int"), (F.col("start") + F.col("rank") - 1).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Write the shuffled rows as Parquet, one folder per shard, each file in slot order."""
    out = shard_rows(df, shards, seed)
    out.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
