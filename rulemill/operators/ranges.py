"""Places in an order without sorting the whole table.

Counting refines a histogram of the order key: a bounded sample proposes bounds, one pass counts the rows before each, and
the pass is repeated between the two bounds around the place, until few rows are left between them. Rows that the order
leaves equal are told apart by a hash of the whole row, so that one common key can be cut too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.classic.column import Column as ClassicColumn

from rulemill.functions.columns import column

#: Bounds that one pass counts, and keys that are sampled to propose them. Neither grows with the data.
BOUNDS, SAMPLE = 64, 2048
#: A range is not refined below this many rows: they are a top-k.
ROWS = 20_000
#: Rows of a range that one task sorts and numbers, about.
RANGE_ROWS = 1 << 20


@dataclass(frozen=True)
class Key:
    """One item of an order as a column of plain values."""

    name: str
    value: Column
    descending: bool
    nulls_first: bool

    def sorted(self) -> Column:
        if self.descending:
            return F.desc_nulls_first(self.value) if self.nulls_first else F.desc_nulls_last(self.value)
        return F.asc_nulls_first(self.value) if self.nulls_first else F.asc_nulls_last(self.value)

    def before(self, bound) -> Column:
        """Rows that come before a value of this item; never NULL."""
        if bound is None:
            return F.lit(False) if self.nulls_first else self.value.isNotNull()
        nearer = self.value > F.lit(bound) if self.descending else self.value < F.lit(bound)
        return self.value.isNull() | nearer if self.nulls_first else self.value.isNotNull() & nearer


def keys_of(df: DataFrame, order_by: Sequence[Column | str]) -> list[Key]:
    """The items of an order, and a hash of the whole row as the last one."""
    keys = []
    for i, item in enumerate([*order_by, _row_hash(df)]):
        value, descending, nulls_first = _parsed(item)
        kind = df.select(value).schema[0].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.unix_micros(value.cast("timestamp"))  # bounds travel as numbers, whatever the time zone of the driver
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            raise ValueError("rows are ordered by plain values")
        keys.append(Key(f"_key{i}", value, descending, nulls_first))
    return keys


def _row_hash(df: DataFrame) -> Column:
    plain = [F.to_json(column(f.name)) if isinstance(f.dataType, T.MapType) else column(f.name) for f in df.schema if not isinstance(f.dataType, T.VariantType)]
    return F.xxhash64(*plain)


def _parsed(item: Column | str) -> tuple[Column, bool, bool]:
    """(value, descending, NULLs first) of a name or a column with or without a direction."""
    if isinstance(item, str):
        return column(item), False, True
    node = item._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return item, False, True
    value = ClassicColumn(SparkContext._active_spark_context._jvm.org.apache.spark.sql.Column(node.child()))
    return value, "Descending" in node.sortDirection().toString(), "NullsFirst" in node.nullOrdering().toString()


def until(keys: Sequence[Key], bound: Sequence, at_bound: Column | None = None) -> Column:
    """Rows up to a bound, itself included unless `at_bound` is false; never NULL."""
    out = F.lit(True) if at_bound is None else at_bound
    for key, value in reversed(list(zip(keys, bound))):
        out = key.before(value) | (key.value.eqNullSafe(F.lit(value)) & out)
    return out


def between(keys: Sequence[Key], low: Sequence | None, high: Sequence | None) -> Column:
    """Rows after `low` up to `high`. A condition on the first item alone comes first: a scan can take it."""
    out = F.lit(True)
    if low is not None:
        out = out & ~keys[0].before(low[0]) & ~until(keys, low)
    if high is not None:
        out = out & until(keys[:1], high[:1]) & until(keys, high)
    return out


def proposed(rows: DataFrame, keys: Sequence[Key], n: int, total: int) -> list[tuple]:
    """At most `n` bounds in order, evenly spread over a sample of the keys; `total` rows are there."""
    picked = rows.select(*[k.value.alias(k.name) for k in keys])
    if total > SAMPLE:
        picked = picked.sample(fraction=min(1.0, SAMPLE / total), seed=7)
    named = [Key(k.name, F.col(k.name), k.descending, k.nulls_first) for k in keys]
    found = [tuple(r) for r in picked.orderBy(*[k.sorted() for k in named]).limit(4 * SAMPLE).collect()]
    return list(dict.fromkeys(found[i * len(found) // n] for i in range(n) if found)) if len(found) > n else list(dict.fromkeys(found))


def counted(rows: DataFrame, keys: Sequence[Key], bounds: Sequence[tuple], at_bound: Column | None = None) -> tuple[list[int], int]:
    """Rows up to each bound, and all rows, by one pass."""
    found = rows.agg(*[F.count_if(until(keys, b, at_bound)).alias(f"n{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("n")).first()
    return list(found)[:-1], found[-1]


def selected(df: DataFrame, order_by: Sequence[Column | str], first: int, size: int) -> DataFrame:
    """The rows at places `first` to `first + size - 1` (from 0) of the order, sorted. Jobs that count find the range they lie in; only
    that range is sorted, and nothing is stored."""
    keys = keys_of(df, order_by)
    low, high, before = None, None, 0
    _, total = counted(df, keys, [])
    last, left = first + size, total
    while left > max(ROWS, 2 * size):
        rows = df.where(between(keys, low, high))
        bounds = proposed(rows, keys, BOUNDS, left)
        counts, _ = counted(rows, keys, bounds)
        below = [(before + n, b) for n, b in zip(counts, bounds) if before + n <= first]
        above = [(before + n, b) for n, b in zip(counts, bounds) if before + n >= last]
        new_low, new_high = max(below, default=(before, low), key=lambda x: x[0]), min(above, default=(before + left, high), key=lambda x: x[0])
        if new_high[0] - new_low[0] >= left:
            # nearly all rows are alike in every column: the page needs as many of them, whichever
            starts, _ = counted(rows, keys, bounds, F.lit(False))
            for bound, start, stop in zip(bounds, starts, counts):
                if before + start <= first < before + stop:
                    copies = df.where(until(keys, bound) & ~until(keys, bound, F.lit(False))).limit(min(before + stop, last) - first)
                    rest = last - before - stop
                    every = copies.unionByName(selected(df, order_by, before + stop, rest)) if rest > 0 else copies
                    return every.orderBy(*[k.sorted() for k in keys])
            break
        (before, low), (end, high) = new_low, new_high
        left = end - before
    rows = df.where(between(keys, low, high))
    return rows.orderBy(*[k.sorted() for k in keys]).offset(first - before).limit(size)


def numbered(df: DataFrame, order_by: Sequence[Column | str], name: str, buckets: int | None = None) -> DataFrame:
    """All rows with their place in the order, from 1. Sampled bounds cut the order into ranges, a pass counts them, and each range is
    numbered by itself from the rows before it: one shuffle, nothing is stored. The counts broadcast have one row for each range."""
    keys = keys_of(df, order_by)
    _, total = counted(df, keys, [])
    buckets = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    bounds = proposed(df, keys, buckets, total)[1:] if buckets > 1 else []
    bucket = "_range"
    while bucket in df.columns:
        bucket += "_"
    placed = df.withColumn(bucket, _range_of(keys, bounds, 0))
    sizes = {r[bucket]: r["count"] for r in placed.groupBy(bucket).count().collect()}
    starts, so_far = {}, 0
    for i in range(len(bounds) + 1):
        starts[i] = so_far
        so_far += sizes.get(i, 0)
    before = F.element_at(F.array(*[F.lit(starts[i]).cast("long") for i in range(len(bounds) + 1)]), F.col(bucket) + 1)
    own = F.row_number().over(Window.partitionBy(bucket).orderBy(*[k.sorted() for k in keys]))
    return placed.withColumn(name, before + own).drop(bucket)


def _range_of(keys: Sequence[Key], bounds: Sequence[tuple], first: int) -> Column:
    """The number of the range of a row, by bisection: as many comparisons as the number of ranges has bits."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(until(keys, bounds[half]), _range_of(keys, bounds[:half], first)).otherwise(_range_of(keys, bounds[half + 1 :], first + half + 1))
