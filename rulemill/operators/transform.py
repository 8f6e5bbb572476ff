"""Transformation rules, applied in table order as one chain of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulemill.functions.columns import column, null_string
from rulemill.plans.rules import (
    BORROW,
    CREATE,
    EXTRACT,
    FILL,
    REPLACE,
    RuleError,
    Rules,
    as_rules,
    check_transformations,
)


def extract_group(c: Column, pattern: str) -> Column:
    """The first group of the first match; the value itself where the pattern is not found."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def apply_transforms(df: DataFrame, rules: Rules, strict: bool = False) -> DataFrame:
    """Apply the rules that can be applied.

    A rule that cannot be applied (an absent column, a pattern that is blank, not valid or without a group to extract, a
    fill value that is not of the column's type) is skipped, unless `strict`, and `transform_problems` lists it; unknown
    functions are skipped. Rules are folded per column into as few projections as possible: a new projection
    starts only where an `extract` follows another rule on its column, because `extract` refers to its input
    three times.
    """
    listed = as_rules(rules, "transformation")
    problems = check_transformations(listed, df.schema)
    if strict and problems:
        raise RuleError(problems)
    skipped = {number for number, _, _ in problems}
    pending: dict[str, Column] = {}
    types = {f.name: f.dataType for f in df.schema}

    for rule in listed:
        if rule["rule_no"] in skipped:
            continue
        name, function = rule["attribute"], rule["function"]
        pattern, replacement = rule["regular expression"], rule["replacement"]
        if function == EXTRACT and name in pending:
            df, pending = df.withColumns(pending), {}
        current = pending.get(name, column(name))
        if function == REPLACE:
            pending[name] = F.regexp_replace(current.cast("string"), pattern, replacement or "")
        elif function == EXTRACT:
            pending[name] = extract_group(current.cast("string"), pattern)
        elif function == CREATE:
            pending[name] = null_string()
        elif function == BORROW:
            other = pending.get(replacement, column(replacement))
            same = types[replacement] == types[name]
            pending[name] = F.coalesce(current, other if same else other.try_cast(types[name]))
        elif function == FILL:
            pending[name] = F.coalesce(current, F.lit(replacement).try_cast(types[name]))
        if function in (REPLACE, EXTRACT, CREATE):
            types[name] = T.StringType()
    return df.withColumns(pending) if pending else df


def transform_problems(df: DataFrame, rules: Rules) -> list[tuple[int, str, str]]:
    """(rule_no, attribute, message) for every rule that does not fit the columns of `df`."""
    return check_transformations(as_rules(rules, "transformation"), df.schema)
