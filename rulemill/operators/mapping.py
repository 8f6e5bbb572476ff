"""Source columns to target columns: rename by rule, conform to a schema, small projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from rulemill.functions.columns import blank_to_null, column, null_string
from rulemill.plans.rules import RuleError, Rules, as_rules


def map_columns(df: DataFrame, rules: Rules, constants: Mapping[str, str] | None = None) -> DataFrame:
    """Rename, reorder and prune by mapping rules; a source column that is absent gives NULL.

    `constants` adds columns with one fixed value.
    """
    listed = as_rules(rules, "mapping")
    targets = [r["attribute"] for r in listed]
    repeated = sorted({t for t in targets if targets.count(t) > 1})
    if repeated:
        raise RuleError([(0, t, "mapped more than once") for t in repeated])
    mapped = [
        (column(r["name of column"]) if r["name of column"] in df.columns else null_string()).alias(r["attribute"])
        for r in listed
    ]
    return df.select(*mapped, *[F.lit(v).alias(k) for k, v in (constants or {}).items()])


def conform(df: DataFrame, schema: Sequence[str]) -> DataFrame:
    """All columns of the target schema in its order (NULL where absent), then any extra columns."""
    present = set(df.columns)
    wanted = [column(c) if c in present else null_string().alias(c) for c in schema]
    return df.select(*wanted, *[column(c) for c in df.columns if c not in set(schema)])


def missing_columns(df: DataFrame, schema: Sequence[str]) -> list[str]:
    return [c for c in schema if c not in set(df.columns)]


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns cannot take {len(names)} names")
    return df.toDF(*names)


def trim_all(df: DataFrame) -> DataFrame:
    """Trim every column, as text."""
    return df.select(*[F.trim(column(c)).alias(c) for c in df.columns])


# What counts as white space around a cell.
BLANKS = " \t\r\n\f\x0b"


def clean_cells(df: DataFrame) -> DataFrame:
    """Text cells without surrounding white space, and NULL where nothing is left."""
    text = [f.name for f in df.schema if f.dataType == T.StringType()]
    return df.withColumns({c: blank_to_null(F.btrim(column(c), F.lit(BLANKS))) for c in text}) if text else df


def expand_struct(df: DataFrame, name: str) -> DataFrame:
    """Replace a struct column by its fields, at the end."""
    rest = [column(c) for c in df.columns if c != name]
    fields = df.schema[name].dataType.names
    return df.select(*rest, *[column(name).getField(f).alias(f) for f in fields])


def create_attribute(df: DataFrame, name: str) -> DataFrame:
    """Add an all-NULL text column; it is an error if the column exists."""
    if name in df.columns:
        raise RuleError([(0, name, f"column {name} is there already")])
    return df.withColumn(name, null_string())
