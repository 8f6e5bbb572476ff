"""In-row grouping of array elements, linear after one sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from rulemill.functions.columns import let


def with_position(arr: Column) -> Column:
    """array<T> -> array<struct<pos int, item T>>."""
    return F.transform(arr, lambda x, i: F.struct(i.alias("pos"), x.alias("item")))


def group_items(arr: Column, key: Callable[[Column], Column]) -> Column:
    """array<T> -> array<struct<key, first_pos, items array<T>>>, groups in order of appearance.

    Elements whose key is NULL are dropped. The array is sorted by (key, position) once and cut at
    the places where the key changes, so no element is compared with every other.
    """
    tagged = F.filter(
        F.transform(arr, lambda x, i: F.struct(key(x).alias("key"), i.alias("pos"), x.alias("item"))),
        lambda t: t["key"].isNotNull(),
    )

    def cut(ordered: Column) -> Column:
        at = lambda i: F.get(ordered, i)
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (at(i)["key"] != at(i - 1)["key"]),
        )

        def slices(begin: Column) -> Column:
            groups = F.transform(
                begin,
                lambda i, n: F.struct(
                    at(i)["pos"].alias("first_pos"),
                    at(i)["key"].alias("key"),
                    F.transform(
                        F.slice(ordered, i + 1, F.coalesce(F.get(begin, n + 1), F.size(ordered)) - i),
                        lambda t: t["item"],
                    ).alias("items"),
                ),
            )
            return F.array_sort(groups)

        return let(starts, slices)

    return let(F.array_sort(tagged), lambda ordered: F.when(F.size(ordered) > 0, cut(ordered)))


def leading(items: Column, holds: Callable[[Column], Column]) -> Column:
    """How many elements at the front of an array satisfy `holds`, which none behind them does. A search by halves; `items` should be a column
    or a variable, for it is looked at in every step."""
    start = F.struct(F.lit(0).alias("low"), F.size(items).alias("high"))

    def halve(found: Column, _: Column) -> Column:
        middle = F.floor((found["low"] + found["high"]) / 2).cast("int")
        go_on, below = found["low"] < found["high"], F.coalesce(holds(F.get(items, middle)), F.lit(False))
        return F.struct(
            F.when(go_on & below, middle + 1).otherwise(found["low"]).alias("low"), F.when(go_on & ~below, middle).otherwise(found["high"]).alias("high")
        )

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1.0)).cast("int")), start, halve)["low"]
