"""Importance resampling towards a target by hashed n-grams, read from prefix checksums.

A document is normalised to words that one blank separates and scanned once: the running CRC-32 after every word is stored.
The CRC of the bytes between two places follows from the two running values, for CRC is linear over GF(2): appending k bytes to
a prefix multiplies its CRC by x^(8k), so the prefix shifted by k bytes cancels out of the longer running value. No n-gram is
ever built as a string, whatever its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from rulemill.functions.columns import column
from rulemill.llm.common import id_and_text, map_rows, written

BUCKETS = 10_000
MAX_N = 1
#: Words of a document that are hashed at once: the running values are stored, the arrays of features are not.
WORDS_AT_ONCE = 1 << 18

# The reflected generator polynomial of CRC-32, and the bytes that separate words (all ASCII but digits and letters).
POLYNOMIAL = 0xEDB88320
_LOWER = bytes(range(0x61, 0x7B))
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _byte_table(basis: np.ndarray) -> np.ndarray:
    """A linear map, given by its values at the 32 bits, as four tables of its values at a byte."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        has = (np.arange(256) >> bit % 8 & 1).astype(bool)
        out[bit // 8, has] ^= basis[bit]
    return out


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """tables: (..., 4, 256), one map for all values or one for each of them."""
    parts = [values >> np.uint32(8 * k) & np.uint32(255) for k in range(4)]
    return tables[0][parts[0]] ^ tables[1][parts[1]] ^ tables[2][parts[2]] ^ tables[3][parts[3]]


class Shift:
    """CRCs shifted by numbers of bytes: multiplied by x^(8 bytes) modulo the polynomial."""

    SMALL = 64

    def __init__(self):
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        byte = bits
        for _ in range(8):
            byte = np.where(byte & 1, byte >> 1 ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
        one = _byte_table(byte)
        small, basis = [], bits
        for _ in range(self.SMALL):
            small.append(_byte_table(basis))
            basis = _apply(one, basis)
        self.small = np.ascontiguousarray(np.stack(small).transpose(1, 0, 2)).reshape(4, -1)
        self.doubled = [_byte_table(basis)]

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = (lengths % self.SMALL) * 256
        out = np.zeros(len(crcs), np.uint32)
        for k in range(4):
            out ^= self.small[k][at + (crcs >> np.uint32(8 * k) & np.uint32(255))]
        rest, power = lengths // self.SMALL, 0
        while rest.any():
            if power == len(self.doubled):
                last = self.doubled[-1]
                self.doubled.append(_byte_table(_apply(last, _apply(last, np.uint32(1) << np.arange(32, dtype=np.uint32)))))
            some = np.flatnonzero(rest & 1)
            out[some] = _apply(self.doubled[power], out[some])
            rest, power = rest >> 1, power + 1
        return out


class Prefixes:
    """The running CRCs of one normalised document: after each word, and with the blank behind it."""

    def __init__(self, text: bytes | None, shift: Shift):
        self.shift = shift
        words = (text or b"").translate(_NORMAL).split()
        # every word but the first with the blank before it
        pieces = b"\n ".join(words).split(b"\n") if words else []
        self.n_words = len(pieces)
        self.after = np.fromiter(accumulate(pieces, lambda crc, piece: zlib.crc32(piece, crc), initial=0), np.uint32, self.n_words + 1)
        self.end = np.zeros(self.n_words + 1, np.int64)
        np.cumsum(np.fromiter(map(len, pieces), np.int64, self.n_words), out=self.end[1:])
        self.blank = _BLANK_STEP[~self.after & np.uint32(255)] ^ ~self.after >> np.uint32(8)
        self.before = ~self.blank  # of the prefix and one blank

    def crcs(self, first: int, last: int, n: int) -> np.ndarray:
        """CRC-32 of the n-grams that start at words first to last - 1."""
        start, stop = np.arange(first, last), np.arange(first + n, last + n)
        lead, begin = self.before[start], self.end[start] + 1
        if first == 0 and last > 0:
            lead[0], begin[0] = 0, 0
        return self.after[stop] ^ self.shift(lead, self.end[stop] - begin)


def _blank_step() -> np.ndarray:
    byte = np.arange(256, dtype=np.uint32) ^ np.uint32(0x20)
    for _ in range(8):
        byte = np.where(byte & 1, byte >> 1 ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
    return byte


_BLANK_STEP = _blank_step()
_SHIFT = Shift()


def buckets_of(text: bytes | None, max_n: int, buckets: int) -> Iterator[np.ndarray]:
    """The buckets of all runs of 1 to max_n words, some at a time. `accumulate` has seen each byte once."""
    found = Prefixes(text, _SHIFT)
    for n in range(1, max_n + 1):
        for first in range(0, found.n_words - n + 1, WORDS_AT_ONCE):
            yield found.crcs(first, min(first + WORDS_AT_ONCE, found.n_words - n + 1), n) % np.uint32(buckets)


def bucket_counts(df: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(bucket, n): the features of all texts. Each partition sends one row for each bucket at most."""

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros(buckets, np.int64)
        for _, text in rows:
            for found in buckets_of(text, max_n, buckets):
                total += np.bincount(found, minlength=buckets)
        for bucket in np.flatnonzero(total):
            yield int(bucket), int(total[bucket])

    counts = map_rows(id_and_text(df, id_column, text_column), count, "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """1000 ln of how much likelier a bucket is in the target, each with 1 added, rounded down. `buckets` numbers reach the driver, however
    large the corpus is."""

    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for bucket, n in df.collect():
            out[bucket] = n
        return out

    s, t = counts(raw), counts(target)
    s_all, t_all = float(s.sum()), float(t.sum())
    ratio = lambda a, b: (a + 1.0) * (s_all + buckets) / ((b + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(float(a), float(b)))) for a, b in zip(t, s)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, max_n: int = MAX_N, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): a document's weight is the sum of the gains of its features; without features it is 0."""

    def weigh(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            n_words = features = weight = 0
            for i, found in enumerate(buckets_of(text, max_n, len(gain))):
                features += len(found)
                weight += int(gain[found].sum())
            n_words = features if max_n == 1 else len((text or b"").translate(_NORMAL).split())
            yield doc_id, n_words, features, weight

    return map_rows(id_and_text(df, id_column, text_column), weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel_score(weight: Column, key: Column, seed: int) -> Column:
    """Weight plus Gumbel noise from the hash of the seed and the key, so that the highest scores are a draw without replacement."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def ranked(scored: DataFrame, share: tuple[int, int], least_words: int) -> DataFrame:
    """Add `rank` to (doc_id, n_words, ..., score): 1, 2, 3 ... by falling score, then doc_id (NULL last), for the first share of the rows with
    enough words; NULL for the others.

    Rows are dealt by ranges of the order and frozen in a table; a row's rank is the rows of the ranges before it and its place in its
    own. What is broadcast has one row for each range.
    """
    enough = F.col("n_words") >= least_words
    order = [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "draw")
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"), F.count_if(enough).alias("enough"))
    totals = sizes.select(
        "part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.floor(F.lit(share[0]) * F.sum("enough").over(Window.partitionBy()) / share[1]).alias("drawn"),
    )
    rank = F.col("before") + F.col("place") + 1
    out = placed.join(F.broadcast(totals), "part")
    return out.withColumn("rank", F.when(enough & (rank <= F.col("drawn")), rank)).drop("part", "place", "before", "drawn")


def resample(
    df: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: int = 2024, max_n: int = MAX_N,
    buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_features`, `weight`, `score` and, where it is drawn, its `rank`.

    `target` has the same text column, and any columns beside it. Words are runs of ASCII letters (A-Z lower-cased), digits and all other characters
    beyond ASCII. A NULL text has no words; repeated ids and texts stay rows of their own, of which equal scores and ids rank in any order.
    An empty table gives no rows, an empty target draws by noise and rarity alone. Texts are read twice, only numbers are shuffled.
    """
    sample = target.select(F.lit(0).alias("doc_id"), column(text_column).alias("text"))
    gain = gains(bucket_counts(df, max_n, buckets, id_column, text_column), bucket_counts(sample, max_n, buckets), buckets)
    found = weights(df, gain, max_n, id_column, text_column)
    return ranked(found.withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed)), share, least_words)
