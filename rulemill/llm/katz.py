"""Language-model scores by Katz backoff.

A seen n-gram has its discounted relative frequency, r d(r) / c(context); an unseen one has the backoff weight of its context
times the probability of the n-gram without its first word, down to single words and to one class for all unknown words.
Discounts are Good-Turing's for counts up to 5. The weight is what the discounts leave, over what the seen words do not have in
the shorter model, so that the probabilities after every context add up to 1.

The corpus is cut into chunks of bounded size whose words are numbered. Every chunk sends its distinct n-grams, as sorted 64-bit
hashes with their training counts, to tables that are partitioned by ranges of the hash; a partition adds up and answers each
chunk in the order of its question. Backoff weights are gathered by context in the same way. Tokens are never shuffled one by
one, a frequent word is one entry of each chunk, and no task or driver holds a vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from rulemill.functions.columns import column
from rulemill.llm.common import Scratch, bounded_batches, schema_of

#: Bytes of text in a chunk, unless one text is longer, and n-grams of all chunks in a partition of the tables.
CHUNK_BYTES = 8 << 20
TABLE_ROWS = 1 << 20
ORDER = 2
#: Counts above this are taken as they are.
DISCOUNTED = 5

CHUNK = "chunk long, ids array<long>, training binary, ends binary, tokens binary, words binary, n_tokens long"
ASKED = "level int, bucket int, chunk long, keys binary, counts binary"
TOLD = "level int, bucket int, chunk long, totals binary, first binary, summary array<long>"
PARTIAL = "level int, bucket int, chunk long, keys binary, sums binary"
WEIGHED = "level int, bucket int, chunk long, denominators binary, weights binary"
SCORES = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double"

BEGIN, END = 0, 1
_RESERVED = [xxhash.xxh64_intdigest(b" begin"), xxhash.xxh64_intdigest(b" end")]  # no word holds a blank
#: Probabilities are added as integers of this scale, so that the order of adding does not matter.
_ONE = 1 << 62


def _packed(values: np.ndarray) -> bytes:
    """Compressed by byte planes: most values share their high bytes, sorted ones the highest."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(-1, flat.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _mixed(context: np.ndarray, word: np.ndarray, level: int) -> np.ndarray:
    """64-bit hashes of n-grams from those of context and word."""
    with np.errstate(over="ignore"):
        x = context * np.uint64(0x9E3779B97F4A7C15) + (word ^ np.uint64(level * 0xD6E8FEB86659FD93 % 2**64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    number: dict[bytes, int] = {}
    ids, training, sizes, tokens, held = [], bytearray(), [], [], 0

    def row() -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        flat = np.concatenate(tokens)
        values = [[0], [ids], [bytes(training)], [_packed(np.cumsum(sizes, dtype=np.int64))], [_packed(flat)], [_packed(hashes)], [len(flat)]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, types)], schema=types)

    for batch in batches:
        for doc_id, text, learnt in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and held + len(text or b"") > limit:
                yield row()
                number.clear()
                ids, training, sizes, tokens, held = [], bytearray(), [], [], 0
            words = (text or b"").lower().split()
            at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)) + np.uint32(2)
            tokens.append(np.append(at, np.uint32(END)))
            ids.append(doc_id)
            training.append(bool(learnt))
            sizes.append(len(words) + 1)
            held += len(text or b"")
    if ids:
        yield row()


@dataclass
class _Level:
    """The distinct n-grams of a chunk; number 0 stands for the begin of a text."""

    keys: np.ndarray
    counts: np.ndarray
    #: numbers of the context and of the n-gram without its first word
    context: np.ndarray
    shorter: np.ndarray
    #: number at every place
    at: np.ndarray


class _Chunk:
    """Documents one after the other, each with a place for the begin in front and the end token behind."""

    def __init__(self, row: dict, order: int):
        self.chunk, self.ids = row["chunk"], row["ids"]
        self.training = np.frombuffer(row["training"], np.uint8).astype(bool)
        ends, tokens = _unpacked(row["ends"], "<i8"), _unpacked(row["tokens"], "<u4").astype(np.int64)
        sizes = np.diff(ends, prepend=0)
        self.starts = ends - sizes + np.arange(len(ends))  # where the begin of each document stands
        self.tokens = np.insert(tokens, ends - sizes, BEGIN)
        self.real = np.ones(len(self.tokens), bool)
        self.real[self.starts] = False
        self.sizes = sizes
        learnt = np.repeat(self.training, sizes + 1) & self.real
        keys = np.concatenate((np.array(_RESERVED, np.uint64), _unpacked(row["words"], "<u8")))
        none = np.zeros(len(keys), np.int64)
        self.levels = [_Level(keys, np.bincount(self.tokens[learnt], minlength=len(keys)), none, none, self.tokens)]
        for level in range(2, order + 1):
            last = self.levels[-1]
            before = np.concatenate(([0], last.at[:-1]))
            code = before * len(keys) + self.tokens
            code[~self.real] = -1  # sorted to number 0
            kinds, first, at = np.unique(code, return_index=True, return_inverse=True)
            context, word = kinds // len(keys), kinds % len(keys)
            context[0] = word[0] = 0
            self.levels.append(
                _Level(_mixed(last.keys[context], keys[word], level), np.bincount(at[learnt], minlength=len(kinds)), context, last.at[first], at)
            )

    def questions(self, level: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, numbers in the order of their keys)."""
        keys = self.levels[level - 1].keys
        order = np.argsort(keys, kind="stable")
        bucket = _bucket(keys[order], buckets)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
        for a, b in zip(edges, edges[1:]):
            yield int(bucket[a]), order[a:b]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def discounts(kinds: list[int]) -> list[float]:
    """d(0) to d(5) from the numbers of n-grams that occur 1 to 6 times, Katz' form of Good-Turing's estimate. Where the numbers allow no
    discount above 0 and up to 1, it is 1."""
    out = [1.0] * (DISCOUNTED + 1)
    if not kinds[0]:
        return out
    common = (DISCOUNTED + 1) * kinds[DISCOUNTED] / kinds[0]
    for r in range(1, DISCOUNTED + 1):
        if kinds[r - 1] and common < 1:
            d = ((r + 1) * kinds[r] / (r * kinds[r - 1]) - common) / (1 - common)
            out[r] = d if 0 < d <= 1 else 1.0
    return out


@dataclass(frozen=True)
class Statistics:
    """A few numbers of each level: n-grams that occur 1 to 6 times, distinct ones, all."""

    kinds: list[list[int]]
    buckets: int
    distinct: int
    total: int

    def discounted(self, level: int, counts: np.ndarray) -> np.ndarray:
        d = np.array(discounts(self.kinds[level - 1]))
        return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)

    def lost(self, level: int, kinds: np.ndarray) -> np.ndarray:
        """What the discounts take from contexts that have (n, 5) n-grams that occur 1 to 5 times."""
        d = np.array(discounts(self.kinds[level - 1])[1:])
        return kinds @ ((1 - d) * np.arange(1, DISCOUNTED + 1))

    def words(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of single words; a count of 0 stands for the class of unknown words."""
        lost = float(self.lost(1, np.array(self.kinds[0][:DISCOUNTED], float)))
        total, rest = (self.total, lost) if lost > 0 else (self.total + 1, 1.0)
        return np.where(counts > 0, self.discounted(1, counts), rest) / total


def _tables(df: DataFrame, run: Callable[[pa.Table], list[tuple]], schema: str) -> DataFrame:
    types = schema_of(df.sparkSession, schema)

    def apply(table: pa.Table) -> pa.Table:
        rows = run(table)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(types), types)], schema=types)

    return df.groupBy("level", "bucket").applyInArrow(apply, schema)


def _added(table: pa.Table) -> list[tuple]:
    """One partition of the counts: totals for each chunk, the n-grams of which a chunk is the first to know, and how many there are."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [_unpacked(r["keys"], "<u8") for r in rows]
    kinds, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.bincount(which, np.concatenate([_unpacked(r["counts"], "<u4") for r in rows]), len(kinds)).astype(np.int64)
    is_first = np.zeros(len(which), bool)
    is_first[first] = totals > 0
    seen = totals[totals > 0]
    summary = [*np.bincount(seen[seen <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:].tolist(), len(seen), int(seen.sum())]
    out, at = [], 0
    for row, key in zip(rows, keys):
        part = slice(at, at + len(key))
        out.append((row["level"], row["bucket"], row["chunk"], _packed(totals[which[part]]), np.packbits(is_first[part]).tobytes(), [] if out else summary))
        at += len(key)
    return out


def _weighed(statistics: Statistics, level: int, table: pa.Table) -> list[tuple]:
    """One partition of the contexts: what divides their counts, and their backoff weights."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [_unpacked(r["keys"], "<u8") for r in rows]
    kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((len(kinds), DISCOUNTED + 2), np.int64)
    np.add.at(sums, which, np.concatenate([_unpacked(r["sums"], "<i8").reshape(-1, DISCOUNTED + 2) for r in rows]))
    total, shorter = sums[:, 0], sums[:, 1]
    lost = statistics.lost(level, sums[:, 2:].astype(float))
    # a context whose counts are all beyond the discounts gives away one count, one that was never followed everything
    denominators = np.where(lost > 0, total, total + 1)
    rest = np.where(lost > 0, lost, 1.0) / denominators
    weights = np.where(total > 0, rest * _ONE / np.maximum(_ONE - shorter, 1), 1.0)
    out, at = [], 0
    for row, key in zip(rows, keys):
        part = which[at : at + len(key)]
        out.append((row["level"], row["bucket"], row["chunk"], _packed(denominators[part]), _packed(weights[part])))
        at += len(key)
    return out


class _Answered:
    """A chunk with the answers to its questions."""

    def __init__(self, chunk: _Chunk, answers: list[dict], statistics: Statistics):
        self.chunk, self.statistics = chunk, statistics
        told = {(r["level"], r["bucket"]): r for r in answers if r["totals"] is not None}
        weighed = {(r["level"], r["bucket"]): r for r in answers if r["weights"] is not None}
        self.totals, self.first, self.weights, self.denominators = [], [], {}, {}
        for level, own in enumerate(chunk.levels, 1):
            totals, first = np.zeros(len(own.keys), np.int64), np.zeros(len(own.keys), bool)
            for bucket, numbers in chunk.questions(level, statistics.buckets):
                answer = told[level, bucket]
                totals[numbers] = _unpacked(answer["totals"], "<i8")
                first[numbers] = np.unpackbits(np.frombuffer(answer["first"], np.uint8), count=len(numbers)).astype(bool)
            self.totals.append(totals)
            self.first.append(first)
        for level in {level for level, _ in weighed}:
            size = len(chunk.levels[level - 2].keys)
            self.weights[level], self.denominators[level] = np.ones(size), np.ones(size, np.int64)
            for bucket, numbers in chunk.questions(level - 1, statistics.buckets):
                self.denominators[level][numbers] = _unpacked(weighed[level, bucket]["denominators"], "<i8")
                self.weights[level][numbers] = _unpacked(weighed[level, bucket]["weights"], "<f8")

    def probabilities(self, level: int) -> np.ndarray:
        """Of each n-gram of the chunk after its context."""
        totals = self.totals[level - 1]
        if level == 1:
            return self.statistics.words(totals)
        own, shorter = self.chunk.levels[level - 1], self.probabilities(level - 1)
        seen = self.statistics.discounted(level, totals) / self.denominators[level][own.context]
        return np.where(totals > 0, seen, self.weights[level][own.context] * shorter[own.shorter])

    def partial(self, level: int) -> np.ndarray:
        """For each context: its tokens, their probability in the shorter model, n-grams that occur 1 to 5 times; of the n-grams that this
        chunk is the first to know, so that each counts once in all."""
        own = self.chunk.levels[level - 1]
        mine = np.flatnonzero(self.first[level - 1])
        context, counts = own.context[mine], self.totals[level - 1][mine]
        sums = np.zeros((len(self.chunk.levels[level - 2].keys), DISCOUNTED + 2), np.int64)
        shorter = np.rint(self.probabilities(level - 1)[own.shorter[mine]] * _ONE).astype(np.int64)
        np.add.at(sums, (context, 0), counts)
        np.add.at(sums, (context, 1), shorter)
        rare = counts <= DISCOUNTED
        np.add.at(sums, (context[rare], counts[rare] + 1), 1)
        return sums

    def scores(self) -> Iterator[tuple]:
        chunk, statistics = self.chunk, self.statistics
        levels = len(chunk.levels)
        if not len(chunk.ids):
            return
        log = np.log10(self.probabilities(levels))[chunk.levels[-1].at]
        counts = self.totals[0][chunk.tokens]
        base = np.log10((counts + 0.5) / (statistics.total + 0.5 * (statistics.distinct + 1)))
        add = lambda values: np.add.reduceat(np.where(chunk.real, values, 0), chunk.starts).tolist()
        yield from zip(chunk.ids, chunk.training.tolist(), chunk.sizes.tolist(), add(counts > 0), add(base), add(log))


def _answered(chunks: DataFrame, answers: DataFrame, order: int, statistics: Statistics, run: Callable[[_Answered], Iterator[tuple]], schema: str) -> DataFrame:
    types = schema_of(chunks.sparkSession, schema)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(run(_Answered(_Chunk(left.to_pylist()[0], order), right.to_pylist(), statistics)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(types), types)], schema=types)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, schema)


def score(
    df: DataFrame, training: Column, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, table_rows: int = TABLE_ROWS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document, with the model of the rows for which `training` holds: `doc_id`, `training`, `n_tokens` (words and one end),
    `n_known`, `train_tokens`, `base_score` (single words, 0.5 added to each count) and `score`, log10 probabilities of the text.

    Words are lower-cased in A-Z. A NULL text is empty: its end is scored. Repeated ids stay rows; a NULL `training` is false; without
    training rows every token is unknown and has probability 1 in the model. Other columns are not read; an empty table gives no rows.
    n-grams are told apart by 64-bit hashes. `order` is the length of the longest n-gram. The counts and backoff weights are written as
    tables partitioned by hash and deleted when the scores are.
    """
    if order < 1:
        raise ValueError("order starts at 1")
    spark = df.sparkSession
    bounded_batches(spark)
    scratch, types = Scratch(spark), schema_of(spark, CHUNK)
    texts = df.select(
        column(id_column).cast("long").alias("doc_id"), column(text_column).cast("string").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("learnt")
    )
    cut = texts.mapInArrow(lambda batches: _chunks(batches, chunk_bytes, types), CHUNK).withColumn("chunk", F.monotonically_increasing_id())
    chunks = scratch.write(cut, "katz-chunks")
    # every distinct n-gram of a chunk stands at a place of its own, so tokens bound them
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, math.ceil(tokens / table_rows))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, order)
                for level, own in enumerate(chunk.levels, 1):
                    asked = [
                        (level, bucket, chunk.chunk, _packed(own.keys[numbers]), _packed(own.counts[numbers].astype(np.uint32)))
                        for bucket, numbers in chunk.questions(level, buckets)
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*asked), asked_types)], schema=asked_types)

    asked_types = schema_of(spark, ASKED)
    counts = scratch.write(_tables(chunks.mapInArrow(ask, ASKED), _added, TOLD), "katz-counts")
    summed = {
        r["level"]: list(r)[1:]
        for r in counts.filter(F.size("summary") > 0).groupBy("level").agg(*[F.sum(F.get("summary", F.lit(i))).alias(f"s{i}") for i in range(DISCOUNTED + 3)]).collect()
    }
    none = [0] * (DISCOUNTED + 3)
    statistics = Statistics(
        [summed.get(level, none)[: DISCOUNTED + 1] for level in range(1, order + 1)], buckets, summed.get(1, none)[-2], summed.get(1, none)[-1]
    )
    absent = {c: F.lit(None).cast("binary") for c in ("denominators", "weights")}
    answers = counts.select("level", "bucket", "chunk", "totals", "first").withColumns(absent)
    for level in range(2, order + 1):

        def partial(found: _Answered, level: int = level) -> Iterator[tuple]:
            sums = found.partial(level)
            keys = found.chunk.levels[level - 2].keys
            for bucket, numbers in found.chunk.questions(level - 1, buckets):
                yield level, bucket, found.chunk.chunk, _packed(keys[numbers]), _packed(sums[numbers].ravel())

        parts = _answered(chunks, answers, order, statistics, partial, PARTIAL)
        weights = scratch.write(_tables(parts, lambda table, level=level: _weighed(statistics, level, table), WEIGHED), "katz-weights")
        known = {c: F.lit(None).cast("binary") for c in ("totals", "first")}
        answers = answers.unionByName(weights.withColumns(known))
    scored = _answered(chunks, answers, order, statistics, _Answered.scores, SCORES)
    out = scratch.result(scored, "katz-scores")
    return out.withColumn("train_tokens", F.lit(statistics.total).cast("long"))
