"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F


def column(name: str) -> Column:
    """Reference a top-level column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_string() -> Column:
    """A typed NULL. An untyped one cannot be written to CSV."""
    return F.lit(None).cast("string")


def blank_to_null(c: Column) -> Column:
    """Empty text as NULL, the value an empty CSV cell reads back as."""
    return F.nullif(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it many times in `body`.

    Without it, an expression that a lambda refers to is computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def null_if_empty(arr: Column) -> Column:
    return let(arr, lambda a: F.when(F.size(a) > 0, a))


def any_of(conditions: Iterable[Column]) -> Column:
    return _balanced(list(conditions), lambda a, b: a | b, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return _balanced(list(conditions), lambda a, b: a & b, F.lit(True))


def _balanced(items: list[Column], combine, empty: Column) -> Column:
    # Pairing neighbours keeps the expression shallow when there are hundreds of rules.
    if not items:
        return empty
    while len(items) > 1:
        pairs = [combine(a, b) for a, b in zip(items[::2], items[1::2])]
        items = pairs + items[len(pairs) * 2:]
    return items[0]
