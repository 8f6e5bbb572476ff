"""Query rules and predicate trees compiled to one boolean Column.

Values become literals and never SQL text, and a column that already has a number type is compared as
it is, so the scan can use the predicate.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulemill.functions.casts import comparable, is_text, number_literal, parse_boolean, parse_number
from rulemill.functions.columns import all_of, any_of, column
from rulemill.plans.rules import (
    Rule,
    RuleError,
    Rules,
    as_rules,
    check_queries,
    is_blank_query,
    query_values,
    trimmed,
)

X = TypeVar("X")

# Builder operator names and the rule conditions they stand for.
BUILDER_OPERATORS = {
    "equal": "=",
    "not_equal": "!=",
    "less": "<",
    "less_or_equal": "<=",
    "greater": ">",
    "greater_or_equal": ">=",
    "between": "between",
    "not_between": "not between",
    "in": "in",
    "not_in": "not in",
    "is_null": "is null",
    "is_not_null": "is not null",
    "like": "like",
}


def compile_condition(
    name: str, rule_type: str, condition: str, value, source: T.DataType | None = None
) -> Column:
    """One typed comparison, e.g. ("start", "integer", ">", "100")."""
    return condition_on(column(name), name, rule_type, condition, value, source)


def condition_on(raw: Column, name: str, rule_type: str, condition: str, value, source: T.DataType | None = None) -> Column:
    """The same for any value, such as a field of an element of a list."""
    if condition == "is null":
        return raw.isNull()
    if condition == "is not null":
        return raw.isNotNull()
    c = comparable(raw, rule_type, source)
    values = [_literal(v, rule_type, source) for v in query_values(condition, value)]
    match condition:
        case "=" | "==":
            return c == values[0]
        case "!=":
            return c != values[0]
        case "<":
            return c < values[0]
        case "<=":
            return c <= values[0]
        case ">":
            return c > values[0]
        case ">=":
            return c >= values[0]
        case "between":
            return c.between(values[0], values[1])
        case "not between":
            return ~c.between(values[0], values[1])
        case "in":
            return c.isin(*values)
        case "not in":
            return ~c.isin(*values)
        case "like" | "LIKE":
            return c.like(query_values(condition, value)[0])
    raise RuleError([(0, name, f"unknown condition {condition}")])


def _literal(text: str, rule_type: str, source: T.DataType | None) -> Column:
    if rule_type == "string":
        return F.lit(text)
    if rule_type == "boolean":
        return F.lit(parse_boolean(text))
    number = parse_number(text)
    if rule_type in ("double", "float") and is_text(source):
        return F.lit(float(number))
    return number_literal(number, source)


def compile_rules(rules: Rules, schema: T.StructType) -> Column:
    """A query-rule table as one predicate.

    `grouping = yes` opens a parenthesis before its condition; the next `no` closes all that are open, and so
    does the end. A run of yes rows therefore nests to the right, and each run is one operand of the outer
    AND/OR list, where AND binds tighter than OR.
    """
    types = {f.name: f.dataType for f in schema}
    condition = lambda r: compile_condition(r["parameter"], r["parameter_type"], r["condition"], r["value"], types[r["parameter"]])
    return fold_rules(checked_rules(rules, types), condition, all_of, any_of)


def checked_rules(rules: Rules, types: Mapping[str, T.DataType]) -> list[Rule]:
    """The query rules that are not blank; wrong ones are an error."""
    listed = [r for r in map(trimmed, as_rules(rules, "query")) if not is_blank_query(r)]
    problems = check_queries(listed, types) if listed else [(0, None, "no query rules")]
    if problems:
        raise RuleError(problems)
    return listed


def fold_rules(listed: Sequence[Rule], leaf: Callable[[Rule], X], both: Callable[[list[X]], X], either: Callable[[list[X]], X]) -> X:
    """What the rules stand for, put together from what each stands for."""
    alternatives: list[list[X]] = [[]]
    run: list[Rule] = []
    for i, rule in enumerate(listed):
        run.append(rule)
        last = i == len(listed) - 1
        if rule["grouping"] == "yes" and not last:
            continue
        alternatives[-1].append(_nest_right(run, leaf, both, either))
        run = []
        if not last and rule["operator"].lower() == "or":
            alternatives.append([])
    return either([both(operands) for operands in alternatives])


def _nest_right(run: list[Rule], leaf, both, either):
    folded = leaf(run[-1])
    for rule in reversed(run[:-1]):
        folded = (both if rule["operator"].lower() == "and" else either)([leaf(rule), folded])
    return folded


def compile_tree(tree: Mapping | str, schema: T.StructType) -> Column:
    """A builder tree {condition, not, rules: [leaf or group]} as one predicate. JSON text is accepted too."""
    node = json.loads(tree) if isinstance(tree, str) else tree
    types = {f.name: f.dataType for f in schema}

    def visit(n: Mapping) -> Column:
        if "rules" not in n:
            return _leaf(n, types)
        if not n["rules"]:
            raise RuleError([(0, None, "a group needs at least one rule")])
        parts = [visit(child) for child in n["rules"]]
        joined = str(n.get("condition", "AND")).upper()
        if joined not in ("AND", "OR"):
            raise RuleError([(0, None, f"a group is AND or OR, not {joined}")])
        combined = all_of(parts) if joined == "AND" else any_of(parts)
        return ~combined if n.get("not") else combined

    return visit(node)


def _leaf(leaf: Mapping, types: Mapping[str, T.DataType]) -> Column:
    name = leaf.get("field") or leaf.get("id")
    rule_type, operator, value = leaf.get("type", "string"), leaf["operator"], leaf.get("value")
    if name not in types:
        raise RuleError([(0, name, f"no column {name}")])
    text = comparable(column(name), "string", types[name])
    match operator:
        case "contains":
            return text.contains(str(value))
        case "not_contains":
            return ~text.contains(str(value))
        case "begins_with":
            return text.startswith(str(value))
        case "not_begins_with":
            return ~text.startswith(str(value))
        case "ends_with":
            return text.endswith(str(value))
        case "not_ends_with":
            return ~text.endswith(str(value))
        case "is_empty":
            return text == ""
        case "is_not_empty":
            return text != ""
    condition = BUILDER_OPERATORS.get(operator, operator)
    if isinstance(value, bool):
        value = str(value).lower()
    if condition in ("between", "not between") and isinstance(value, (list, tuple)):
        value = f"{value[0]} and {value[1]}"
    rule = {
        "rule_no": 0, "grouping": "no", "operator": "and", "parameter": name, "parameter_type": rule_type,
        "condition": condition, "value": value,
    }
    problems = check_queries([rule], types)
    if problems:
        raise RuleError(problems)
    return compile_condition(name, rule_type, condition, value, types[name])


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The SELECT list of a query: the named columns, or all of them."""
    if not columns:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise RuleError([(0, c, f"no column {c}") for c in missing])
    return df.select(*[column(c) for c in columns])


def query(df: DataFrame, rules: Rules, columns: Sequence[str] | None = None) -> DataFrame:
    return project(df.where(compile_rules(rules, df.schema)), columns)


def query_tree(df: DataFrame, tree: Mapping | str, columns: Sequence[str] | None = None) -> DataFrame:
    return project(df.where(compile_tree(tree, df.schema)), columns)


def query_sql(df: DataFrame, predicate: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A predicate written as Spark SQL by the user, on the columns of `df`."""
    return project(df.where(F.expr(predicate)), columns)
