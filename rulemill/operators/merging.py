"""Unify spellings, and the lookups between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rulemill.functions.arrays import group_items
from rulemill.functions.columns import column
from rulemill.functions.stamps import folder


def distinct_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of a column subset."""
    return df.select(*[column(c) for c in columns]).distinct()


def first_spellings(df: DataFrame, keys: Sequence[str], name: str, order_by: str) -> DataFrame:
    """Per key and lower-cased name: the spelling that comes first, and how many rows share it."""
    return (
        df.where(column(name).isNotNull())
        .groupBy(*[column(k) for k in keys], F.lower(column(name)).alias("_folded"))
        .agg(F.min_by(column(name), column(order_by)).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    )


def merge_ci(df: DataFrame, keys: Sequence[str], name: str, order_by: str, salts: int = 1) -> DataFrame:
    """Give every row the first spelling of its name within its key; names differ in case only.

    The rows stay rows, so a name that most of them carry is never gathered in one place; `nest` builds the
    lists afterwards. The lookup side has one row per key and name; AQE broadcasts it when its measured size
    allows and splits hot names otherwise. `salts` splits every name into that many join keys where AQE is off.
    """
    spellings = first_spellings(df, keys, name, order_by).drop("_rows")
    on = [*keys, "_folded"]
    left = df.withColumn("_folded", F.lower(column(name)))
    if salts > 1:
        on.append("_salt")
        left = left.withColumn("_salt", F.pmod(F.xxhash64(column(order_by)), F.lit(salts)).cast("int"))
        spellings = spellings.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    merged = left.join(spellings, on, "left")
    return merged.select(*[column("_first").alias(c) if c == name else column(c) for c in df.columns])


def merge_items_ci(arr: Column, name: str) -> Column:
    """The same inside a row: array<struct> -> array<struct<name, items>>, first spelling kept, order kept."""
    return F.transform(
        group_items(arr, lambda x: F.lower(x[name])),
        lambda g: F.struct(F.get(g["items"], F.lit(0))[name].alias(name), g["items"].alias("items")),
    )


def lookup(df: DataFrame, dimension: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left outer lookup. Spark broadcasts the dimension if its size allows and shuffles otherwise.

    A key that the dimension has twice would multiply rows; it is an error at run time.
    """
    keys = [on] if isinstance(on, str) else list(on)
    values = [c for c in dimension.columns if c not in keys]
    once = dimension.groupBy(*[column(k) for k in keys]).agg(F.count("*").alias("_rows"), F.any_value(F.struct(*[column(c) for c in values])).alias("_row"))
    shown = F.to_json(F.struct(*[column(k) for k in keys]))
    row = F.when(F.col("_rows") > 1, F.raise_error(F.concat(F.lit("repeated lookup key "), shown))).otherwise(F.col("_row"))
    checked = once.select(*[column(k) for k in keys], row.alias("_row")).select(*[column(k) for k in keys], "_row.*")
    return df.join(checked, keys, "left")


def with_constant_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row. More than one row is an error at run time."""
    return df.select("*", *[one_row.select(column(c)).scalar().alias(c) for c in one_row.columns])


def correlated_children(parent_value: Column, children: Column, child_field: str) -> Column:
    """Elements of an array of structs whose field equals a value of the parent, in the same row."""
    return F.filter(children, lambda x: x[child_field] == parent_value)


def join_derived(left: DataFrame, right: DataFrame, derived: Column, right_key: str) -> DataFrame:
    """Inner join on a key computed from the left side."""
    return left.withColumn(right_key, derived).join(right, right_key)


def join_on_folder(names: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Name files and data files of the same folder, side by side."""
    left = names.withColumn("folder", folder(column(path))).drop(path)
    return left.join(files.withColumn("folder", folder(column(path))), "folder")


def new_names(incoming: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Incoming rows whose name is not taken yet."""
    return incoming.join(existing.select(column(name)), name, "left_anti")


def taken_names(incoming: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Incoming rows whose name is taken: the ones to report back."""
    return incoming.join(existing.select(column(name)), name, "left_semi")
