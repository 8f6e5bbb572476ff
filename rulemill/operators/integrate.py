"""Bring sources together and search the result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from rulemill.functions.casts import as_text
from rulemill.functions.columns import column
from rulemill.plans.rules import RuleError


def unite(frames: Sequence[DataFrame], schema: Sequence[str] | None = None) -> DataFrame:
    """Union by name (duplicates kept), missing columns NULL; in the order of `schema` if one is given.

    A column keeps its type if all frames that have it agree; otherwise it is text, so that no cell is lost or refused.
    """
    found: dict[str, set] = {}
    for f in frames:
        for field in f.schema:
            found.setdefault(field.name, set()).add(field.dataType)
    names = list(dict.fromkeys([*(schema or ()), *found]))
    types = {n: found[n].pop() if len(found.get(n, ())) == 1 else T.StringType() for n in names}

    def aligned(f: DataFrame) -> DataFrame:
        have = set(f.columns)
        return f.select(*[(column(n) if n in have else F.lit(None)).cast(types[n]).alias(n) for n in names])

    return reduce(DataFrame.unionByName, map(aligned, frames))


def search(df: DataFrame, parameter: str, value: str) -> DataFrame:
    """Rows whose lower-cased `parameter` column equals `value`.

    Columns of another type are compared as what the value says, so the predicate reaches the scan.
    """
    name = parameter.lower()
    if name not in df.columns:
        raise RuleError([(0, name, f"no column {name}")])
    source = df.schema[name].dataType
    typed = F.lit(value).try_cast(source)
    c = column(name)
    return df.where(as_text(c, source) == value if source.typeName() == "string" else c == typed)


def found_nothing(df: DataFrame) -> bool:
    """True if a search gave no row; stops at the first one."""
    return df.isEmpty()
