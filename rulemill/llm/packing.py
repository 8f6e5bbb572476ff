"""Packing token pieces into as few sequences as it can, by a grouping genetic algorithm.

A chromosome is a set of bins. Crossover injects well-filled bins of one parent into another, drops the bins that would hold
a piece twice, and puts the displaced pieces back best fit first. Pieces are dealt into blocks by a hash; each block is
searched by several islands, which are tasks of their own, and after every epoch each island gets its neighbour's best.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulemill.functions.columns import column
from rulemill.llm.common import id_and_text, map_rows, written
from rulemill.llm.tokens import encoded

#: Pieces in a block, on average; a block is what one island holds in memory.
BLOCK_PIECES = 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 12
#: Bins below this fill are opened once more and packed across blocks.
LEAST_FILL = 0.95

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, close each with the end id, and cut only what is longer than a sequence.

    A NULL text is empty: one piece that holds the end id. `with_ids` adds the ids as little-endian 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, codes, ends in encoded(batches, tokenizer, end_id):
            raw, begin = memoryview(np.ascontiguousarray(codes)).cast("B"), 0
            names, numbers, starts, lengths, sums, ids = [], [], [], [], [], []
            for doc_id, end in zip(doc_ids, ends.tolist()):
                for number, at in enumerate(range(begin, end, capacity)):
                    to = min(end, at + capacity)
                    names.append(doc_id)
                    numbers.append(number)
                    starts.append(at - begin)
                    lengths.append(to - at)
                    sums.append(zlib.crc32(raw[4 * at : 4 * to]))
                    if with_ids:
                        ids.append(bytes(raw[4 * at : 4 * to]))
                begin = end
            columns = [pa.array(names, pa.int64()), pa.array(numbers, pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, lengths, sums))]
            out = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names=out + ["ids"] * with_ids)

    return id_and_text(docs).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


class Bins:
    """A packing under construction. Bins are found by their room through one integer whose bit r says that some bin has room r."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.room = capacity, [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0

    def add_bin(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.bins))
        self.rooms |= 1 << room
        self.bins.append(items)
        self.room.append(room)

    def best_fit(self, item: int, size: int) -> None:
        fitting = self.rooms >> size
        if not fitting:
            self.add_bin([item], self.capacity - size)
            return
        room = size + (fitting & -fitting).bit_length() - 1
        place = self.by_room[room]
        b = place.pop()
        if not place:
            self.rooms ^= 1 << room
        self.bins[b].append(item)
        self.room[b] = room - size
        self.by_room[room - size].append(b)
        self.rooms |= 1 << (room - size)


def _put(bins: Bins, items: list[int], sizes: list[int]) -> Bins:
    for i in sorted(items, key=sizes.__getitem__, reverse=True):
        bins.best_fit(i, sizes[i])
    return bins


def _cost(bins: Bins) -> tuple[int, float]:
    """Fewer bins first; of as many, fuller bins beside emptier ones, which leave more room for what is displaced."""
    return len(bins.bins), -sum((bins.capacity - r) ** 2 for r in bins.room)


def _cross(one: Bins, other: Bins, sizes: list[int], rng: np.random.Generator) -> Bins:
    order = np.argsort(other.room, kind="stable")
    full = order[: max(1, len(order) // 2)]
    chosen = rng.choice(full, max(1, len(full) // 2), replace=False)
    child, used, displaced = Bins(one.capacity), set(), []
    for b in chosen.tolist():
        child.add_bin(list(other.bins[b]), other.room[b])
        used.update(other.bins[b])
    for items, room in zip(one.bins, one.room):
        if used.isdisjoint(items):
            child.add_bin(list(items), room)
        else:
            displaced += [i for i in items if i not in used]
    return _put(child, displaced, sizes)


def _mutate(bins: Bins, sizes: list[int], rng: np.random.Generator) -> Bins:
    """Open the emptiest bins and a few others."""
    order = np.argsort(bins.room)
    opened = set(order[-max(2, len(order) // 50) :].tolist()) | set(rng.integers(0, len(order), max(1, len(order) // 50)).tolist())
    child, displaced = Bins(bins.capacity), []
    for b, (items, room) in enumerate(zip(bins.bins, bins.room)):
        if b in opened:
            displaced += items
        else:
            child.add_bin(list(items), room)
    return _put(child, displaced, sizes)


def evolve(sizes: list[int], capacity: int, migrants: list[list[list[int]]], seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """The best packing of one island after an epoch. It ends early where the number of bins cannot be lower."""
    rng, least = np.random.default_rng(seed), -(-sum(sizes) // capacity)
    people = []
    for groups in migrants:
        b = Bins(capacity)
        for items in groups:
            b.add_bin(list(items), capacity - sum(sizes[i] for i in items))
        people.append(b)
    if not people:
        people.append(_put(Bins(capacity), list(range(len(sizes))), sizes))
    best = min(people, key=_cost)
    if len(best.bins) <= least:
        return best
    while len(people) < population:
        b = Bins(capacity)
        noise = rng.normal(0, 0.05 * capacity, len(sizes))
        for i in np.argsort(-(np.array(sizes) + noise)).tolist():
            b.best_fit(i, sizes[i])
        people.append(b)
    for _ in range(generations):
        one, other = (min(rng.choice(len(people), 2).tolist(), key=lambda i: _cost(people[i])) for _ in range(2))
        child = _cross(people[one], people[other], sizes, rng) if one != other else _mutate(people[one], sizes, rng)
        if rng.random() < 0.5:
            child = _mutate(child, sizes, rng)
        worst = max(range(len(people)), key=lambda i: _cost(people[i]))
        if _cost(child) < _cost(people[worst]):
            people[worst] = child
        best = min(people, key=_cost)
        if len(best.bins) <= least:
            break
    return best


def _packed(items: DataFrame, capacity: int, seed: int, blocks: int) -> DataFrame:
    """(row struct<..., length>) -> (block, items array<row>, groups array<array<int>>): the best packing found for each block."""
    grouped = items.groupBy(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list("row")).alias("items"))
    state = written(grouped, "packing-blocks").withColumn("migrants", F.array().cast("array<array<array<int>>>"))
    for epoch in range(EPOCHS):

        def rows(read: Iterator[tuple], epoch=epoch) -> Iterator[tuple]:
            for block, island, sizes, migrants in read:
                best = evolve(sizes, capacity, migrants, hash((seed, epoch, block, island)) & 0x7FFFFFFF)
                yield block, island, len(best.bins), best.bins

        islands = state.select("block", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.transform("items", lambda r: r["length"]).alias("sizes"), "migrants")
        # ring: island i gets its own best and that of island i - 1
        islands = islands.withColumn("migrants", F.when(F.size("migrants") > 0, F.array(F.get("migrants", F.col("island")), F.get("migrants", (F.col("island") + ISLANDS - 1) % ISLANDS))).otherwise(F.col("migrants")))
        islands = islands.repartition("block", "island")
        found = map_rows(islands, rows, "block long, island int, bins int, groups array<array<int>>", per_batch=16)
        best = written(found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("island", "bins", "groups"))).alias("found")), "packing-epoch")
        state = state.select("block", "items").join(best, "block")
        if epoch < EPOCHS - 1:
            state = state.select("block", "items", F.transform("found", lambda f: f["groups"]).alias("migrants"))
    return state.select("block", "items", F.array_min(F.transform("found", lambda f: F.struct(f["bins"].alias("bins"), f["groups"].alias("groups"))))["groups"].alias("groups"))


def _placed(packed: DataFrame, level: int) -> DataFrame:
    """One row per piece: its row, its sequence, its offset there, and how full the sequence is, `__filled`."""
    # the rows are fetched before the groups become rows of their own, which would each carry all items of the block
    fetched = packed.select("block", F.transform("groups", lambda g: F.transform(g, lambda m: F.get("items", m))).alias("bins"))
    rows = fetched.select("block", F.posexplode("bins").alias("bin", "rows"))
    ends = F.transform("rows", lambda r, i: F.aggregate(F.slice("rows", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["length"]))
    rows = rows.withColumn("at", ends).withColumn("filled", F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x["length"]))
    sequence = (F.lit(level).cast("long") * F.lit(1 << 61)).bitwiseOR(F.shiftleft(F.col("block"), 24)).bitwiseOR(F.col("bin").cast("long"))
    return rows.select(sequence.alias("sequence_id"), "filled", F.explode(F.arrays_zip("rows", "at")).alias("p")).select("p.rows.*", "sequence_id", F.col("p.at").alias("offset"), F.col("filled").alias("__filled"))


def pack(items: DataFrame, capacity: int, seed: int = 0, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Add `sequence_id` and `offset` (gapless from 0 within a sequence) to rows with a `length` between 1 and `capacity`.

    A row as long as a sequence is a sequence of its own. The others are dealt into blocks of about `block_pieces` by a hash of
    the row and its place, so repeated rows and one hot document spread; a block's sequences that stay emptier than `LEAST_FILL`
    are opened and packed again across blocks. A length that is NULL, below 1 or above the capacity is an error. Columns named
    `sequence_id` or `offset` are replaced. An empty table gives an empty result. The input is written to the shared folder once.
    """
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    bad = F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity)
    rows = items.select(F.struct(*map(column, kept), F.monotonically_increasing_id().alias("__place")).alias("row"), F.when(bad, F.raise_error(F.lit("a length does not fit a sequence"))).otherwise(F.col("length")).alias("length"))
    rows = written(rows, "packing-rows")
    whole = rows.filter(F.col("length") == capacity).select("row.*", (F.lit(1 << 62).cast("long") + F.col("row.__place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = rows.filter(F.col("length") < capacity).select("row")
    out = [whole]
    for level in range(2):
        n = parts.count()
        placed = written(_placed(_packed(parts, capacity, seed + level, -(-n // block_pieces) or 1), level), "packing-placed")
        again = F.col("__filled") < LEAST_FILL * capacity if level == 0 else F.lit(False)
        out.append(placed.filter(~again).drop("__filled"))
        parts = placed.filter(again).select(F.struct(*map(column, kept), "__place").alias("row"))
    united = out[0]
    for more in out[1:]:
        united = united.unionByName(more)
    return united.select(*map(column, kept), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with their `ids` -> one row per sequence: its ids, and where its pieces come from. A group is one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("parts"),
        F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("hex"),
    ).select("sequence_id", "parts", F.unhex("hex").alias("ids"))
