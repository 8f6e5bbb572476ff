"""Token ids as a grammar: per shard, frequent id pairs are replaced by nonterminals again and again (Re-Pair).

A shard file holds the rules, how many ids each nonterminal stands for, the symbols that are left, and where each document's
symbols end, so that one document is read without expanding the others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rulemill.llm.common import as_batch, id_and_text, map_rows, schema_of
from rulemill.llm.tokens import chosen_runs, encoded

#: Ids that one shard holds, unless a single document is longer.
SHARD_IDS = 1 << 20
#: Pieces that the encoder keeps, and bytes of text that it encodes at once; more of both is faster and takes more memory.
CACHE_PIECES, BATCH_BYTES = 450_000, 10 << 20
#: Pairs are counted and replaced until none stands twice: how often at most, the most frequent pairs of each time (more, where they are
#: equally frequent), and how rare a pair may be.
ROUNDS, PAIRS_PER_ROUND, LEAST = math.inf, 16384, 2

SHARDS = (
    "part int, number int, first_id long, doc_ids array<long>, n_ids array<int>, symbol_ends array<int>, "
    "terminals int, rules binary, lengths binary, symbols binary"
)


def compress(ids: np.ndarray, ends: np.ndarray, rounds: float = ROUNDS, pairs: int = PAIRS_PER_ROUND, least: int = LEAST):
    """ids of several documents, and where each document ends -> (terminals, rules, lengths, symbols, symbol ends).

    Symbol `terminals + i` stands for the pair rules[i] and for lengths[i] ids. No pair reaches over the end of a document.
    One round takes the most frequent pairs and replaces each where it goes before both pairs that overlap with it; of a run of one symbol every
    other pair. Pairs are told apart by powers of two of their number and then by a hash, so that a long repeat is folded by about half each time.
    A pair that stands less than `least` times cannot become more frequent and is not looked at again.
    """
    terminals = int(ids.max()) + 1 if len(ids) else 0
    seq, many = ids.astype(np.uint32), len(ids)
    last = np.zeros(many, bool)
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    # a replaced pair stands at its first place: the places before and behind that are left, and where a pair begins that may stand `least` times
    behind, before = np.arange(1, many + 1), np.arange(-1, many)
    live, gone = ~last, np.zeros(many, bool)
    made, sizes, done = [np.zeros((0, 2), np.uint32)], np.ones(terminals, np.int64), 0
    while done < rounds:
        at = np.flatnonzero(live)
        ahead = behind.take(at)
        touching = np.append(at[1:] == ahead[:-1], False) if len(at) else live[:0]
        left, right = seq.take(at), seq.take(ahead)
        shift = np.uint64(len(sizes).bit_length())
        codes, counts, group, runs = _pairs(left, right, shift, touching, least)
        if not len(codes):
            break
        done += 1
        first = np.flatnonzero(counts >= (np.partition(counts, -pairs)[-pairs] if len(counts) > pairs else least))
        mixed = (codes[first] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)
        power = np.frexp(counts[first].astype(float))[1].astype(np.uint64)
        rank = np.zeros(len(codes) + 1, np.uint32)
        rank[1 + first[np.argsort(power << np.uint64(56) | mixed, kind="stable")]] = np.arange(1, len(first) + 1)
        order = rank.take(group)
        # of two pairs that overlap, which are neighbours here, the later one in this order gives way
        ahead_of = (order[:-1] > order[1:]) | ~touching[:-1]
        won = order > 0
        won[:-1] &= ahead_of
        won[1:] &= (order[1:] > order[:-1]) | ~touching[:-1]
        hit = np.flatnonzero(won)
        place = group.take(hit)
        taken = np.bincount(place, minlength=len(rank)) >= least
        kept = taken.take(place)
        hit, place = hit[kept], place[kept]
        used = codes[taken[1:]]
        rules = np.stack([used >> shift, used & ((np.uint64(1) << shift) - np.uint64(1))], 1).astype(np.uint32)
        # rare pairs are done with; of a run of one symbol the pairs between are looked at again
        again = group > 0
        again[runs] = True
        live[at] = again
        at, ahead = at.take(hit), ahead.take(hit)
        seq[at] = (len(sizes) - 1 + np.cumsum(taken)).astype(np.uint32).take(place)
        made.append(rules)
        sizes = np.concatenate([sizes, sizes[rules].sum(1)])
        follow = behind.take(ahead)
        behind[at], before[follow] = follow, at
        live[ahead], gone[ahead] = False, True
        closing = last.take(ahead)
        last[at], live[at] = closing, ~closing
        earlier = before.take(at)
        earlier = earlier[earlier >= 0]
        live[earlier] = ~last.take(earlier)
    kept = np.flatnonzero(~gone)
    seq, last, rules = seq.take(kept), last.take(kept), np.concatenate(made)
    symbol_ends = np.zeros(len(ends), np.int64)
    symbol_ends[np.diff(ends, prepend=0) > 0] = np.flatnonzero(last) + 1
    symbols = seq.astype(np.uint16) if len(sizes) <= 1 << 16 else seq
    return terminals, rules, sizes[terminals:].astype(np.uint32), symbols, np.maximum.accumulate(symbol_ends)


def _pairs(left: np.ndarray, right: np.ndarray, shift: np.uint64, touching: np.ndarray, least: int):
    """Pairs of symbols in their order; `touching` tells which of them overlap with the next. -> the distinct ones that stand `least` times without
    overlap, as codes of `shift` bits a symbol; how often; for each pair the number of its code from 1, or 0; and which pairs overlap with an equal one that counts."""
    codes, below = left.astype(np.uint64), np.uint64(len(left).bit_length())
    codes <<= shift
    codes |= right
    if 2 * int(shift) + int(below) <= 64:  # sorted together with their places, which is faster
        codes <<= below
        codes |= np.arange(len(left), dtype=np.uint64)
        codes.sort()
        at = (codes & ((np.uint64(1) << below) - np.uint64(1))).view(np.int64)
        codes >>= below
    else:
        at = np.argsort(codes, kind="stable")
        codes = codes[at]
    starts = np.flatnonzero(np.concatenate((codes[:1] == codes[:1], codes[1:] != codes[:-1])))
    distinct, counts = codes[starts], np.diff(starts, append=len(codes))
    # in a run of one symbol every other pair counts
    same = left == right
    inside = np.flatnonzero(same[1:] & same[:-1] & touching[:-1]) + 1
    start = np.maximum.accumulate(np.where(np.diff(inside, prepend=-1) != 1, inside, 0))
    runs = inside[(inside - start) % 2 == 0]
    single = np.searchsorted(distinct, (left[runs].astype(np.uint64) << shift) | right[runs])
    found = counts - np.bincount(single, minlength=len(counts))
    often = found >= least
    group = np.empty(len(left), np.uint32)
    group[at] = np.repeat(np.where(often, np.cumsum(often), 0).astype(np.uint32), counts)
    group[runs] = 0
    return distinct[often], found[often], group, runs


class Shard:
    """Reads a shard: all ids, or those of one document."""

    def __init__(self, terminals: int, rules: bytes, lengths: bytes, symbols: bytes, symbol_ends: list[int]):
        self.terminals = terminals
        pairs, sizes = np.frombuffer(rules, "<u4").reshape(-1, 2), np.frombuffer(lengths, "<u4").astype(np.int64)
        self.symbols = np.frombuffer(symbols, "<u2" if terminals + len(pairs) <= 1 << 16 else "<u4")
        self.ends = symbol_ends
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.flat = np.zeros(int(sizes.sum()), np.uint32)
        # rules only use earlier symbols; as many as use none of one another are expanded together
        newest, at = pairs.max(1, initial=0).astype(np.int64) - terminals, 0
        while at < len(pairs):
            stop = min(len(pairs), 2 * at + 4096)
            later = np.flatnonzero(newest[at:stop] >= at)
            to = at + int(later[0]) if len(later) else stop
            self.flat[self.starts[at] : self.starts[to - 1] + sizes[to - 1]] = self.expand(pairs[at:to].ravel())
            at = to

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(symbols):
            return np.zeros(0, np.uint32)
        used = int(symbols.max()) + 1 - self.terminals  # rules that are expanded already
        sizes = np.concatenate((np.ones(self.terminals, np.int64), self.sizes[: max(0, used)]))
        flat = np.concatenate((np.arange(self.terminals, dtype=np.uint32), self.flat[: int(sizes[self.terminals :].sum())]))
        return chosen_runs(flat, sizes, symbols)[0]

    def all(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]])


def in_id_order(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and text, range-partitioned and sorted by id. Rows that share an id are spread by text and place, so one id may be hot."""
    rows = id_and_text(docs, id_column, text_column).withColumns({"tie": F.xxhash64("text"), "place": F.spark_partition_id()})
    return rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "text")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append the end id, and write grammar shards in ascending id order.

    A NULL text is empty: its document holds the end id alone. NULL ids come first; rows with the same id stay rows of their own.
    Other columns are not read. An empty table writes no shard.
    """

    types = schema_of(docs.sparkSession, SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first, held = TaskContext.get().partitionId(), 0, 0, 0
        names: list[int] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            n_ids = np.concatenate(sizes)
            terminals, rules, lengths, symbols, ends = compress(np.concatenate(ids), np.cumsum(n_ids))
            row = part, number, first, names, n_ids.tolist(), ends.tolist(), terminals, rules.tobytes(), lengths.tobytes(), symbols.tobytes()
            return as_batch([row], types)

        for doc_ids, codes, ends in encoded(batches, tokenizer, end_id, CACHE_PIECES, BATCH_BYTES):
            at = done = 0
            while at < len(doc_ids):
                # documents that still fit, one at least
                to = max(at + (not names), int(np.searchsorted(ends, done + shard_ids - held, "right")))
                if to > at:
                    names += doc_ids[at:to]
                    ids.append(codes[done : ends[to - 1]])
                    sizes.append(np.diff(ends[at:to], prepend=done))
                    held, at, done = held + int(ends[to - 1]) - done, to, int(ends[to - 1])
                if at < len(doc_ids):
                    yield shard()
                    number, first, held = number + 1, first + held, 0
                    names, ids, sizes = [], [], []
        if names:
            yield shard()

    in_id_order(docs).mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Shards -> (doc_id, start, n_tokens, ids), with the ids as little-endian unsigned 32-bit integers in binary.

    `start` counts the ids of all documents before. Only one total per written part is gathered and sent to the tasks.
    """

    def rows(read: Iterator[tuple]) -> Iterator[tuple]:
        for part, first, doc_ids, n_ids, ends, terminals, rules, lengths, symbols in read:
            all_ids, at = Shard(terminals, rules, lengths, symbols, ends).all().tobytes(), 0
            for doc_id, n in zip(doc_ids, n_ids):
                yield part, doc_id, first + at, n, all_ids[4 * at : 4 * (at + n)]
                at += n

    totals = shards.select("part", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    read = shards.select("part", "first_id", "doc_ids", "n_ids", "symbol_ends", "terminals", "rules", "lengths", "symbols")
    docs = map_rows(read, rows, "part int, doc_id long, first long, n_tokens long, ids binary", per_batch=256)
    # one row per written part, that is per task of the writing job
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
