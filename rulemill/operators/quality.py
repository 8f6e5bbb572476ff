"""Quality rules: flag cells, list them, or count them.

All forms share one compiled condition per rule, evaluated on the original values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rulemill.functions.casts import number_literal, parse_number, tolerant_cast
from rulemill.functions.columns import column
from rulemill.plans.rules import (
    Rule,
    RuleError,
    Rules,
    as_rules,
    check_quality,
    quality_range,
    quality_rule_applies,
)


def quality_condition(rule: Rule, c: Column, source: T.DataType | None) -> Column:
    """Where one rule flags `c`. A comparison with NULL flags nothing."""
    value = tolerant_cast(c, rule["type"], source)
    compared = {"float": T.FloatType(), "double": T.DoubleType()}.get(rule["type"], T.LongType())
    match rule["condition"]:
        case "empty":
            holds = value.isNull()
        case "contains":
            holds = value.contains(rule["value"] or "")
        case "equals":
            holds = value == F.lit(rule["value"])
        case "range":
            low, high = quality_range(rule["value"])
            holds = value.between(number_literal(low, compared), number_literal(high, compared))
        case operator:
            threshold = number_literal(parse_number(rule["value"]), compared)
            holds = {
                ">=": lambda: value >= threshold,
                "<=": lambda: value <= threshold,
                "<": lambda: value < threshold,
                ">": lambda: value > threshold,
                "=": lambda: value == threshold,
            }[operator]()
    return ~holds if rule["not"] == "yes" else holds


def _usable(df: DataFrame, rules: Rules, strict: bool) -> list[Rule]:
    listed = as_rules(rules, "quality")
    problems = check_quality(listed, df.columns)
    if strict and problems:
        raise RuleError(problems)
    bad = {number for number, _, _ in problems}
    return [r for r in listed if r["rule_no"] not in bad and quality_rule_applies(r)]


def quality_problems(df: DataFrame, rules: Rules) -> list[tuple[int, str, str]]:
    return check_quality(as_rules(rules, "quality"), df.columns)


def _source_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema}


def _replaced(rules: list[Rule], types: Mapping[str, T.DataType]) -> dict[str, Column]:
    """Per ruled column: the message of the last rule that flags it, else the cast value as text."""
    by_column: dict[str, list[Rule]] = {}
    for rule in rules:
        by_column.setdefault(rule["attribute"], []).append(rule)
    replaced = {}
    for name, own in by_column.items():
        kept, kept_type = column(name), types[name]
        for rule_type in dict.fromkeys(r["type"] for r in own):
            kept, kept_type = tolerant_cast(kept, rule_type, kept_type), _cast_type(rule_type)
        branches = [(quality_condition(r, column(name), types[name]), r["message"]) for r in reversed(own)]
        picked = F.when(branches[0][0], F.lit(branches[0][1]))
        for condition, message in branches[1:]:
            picked = picked.when(condition, F.lit(message))
        replaced[name] = picked.otherwise(kept.cast("string"))
    return replaced


def _cast_type(rule_type: str) -> T.DataType:
    # What each rule type leaves in the column.
    return {
        "string": T.StringType(), "float": T.FloatType(), "double": T.DoubleType(), "decimal": T.DecimalType(10, 0),
        "byte": T.ByteType(), "short": T.ShortType(), "integer": T.IntegerType(), "long": T.LongType(),
    }[rule_type]


def _findings(rules: list[Rule], types: Mapping[str, T.DataType], value: bool = False) -> Column:
    """Array of what each row violates, in rule order."""
    found = []
    for r in rules:
        c = column(r["attribute"])
        fields = [
            F.lit(r["rule_no"]).alias("rule_no"),
            F.lit(r["attribute"]).alias("attribute"),
            F.lit(r["message"]).alias("message"),
        ]
        if value:
            fields.append(c.cast("string").alias("value"))
        found.append(F.when(quality_condition(r, c, types[r["attribute"]]), F.struct(*fields)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def apply_quality(df: DataFrame, rules: Rules, mode: str = "replace", strict: bool = False) -> DataFrame:
    """Flag bad cells.

    `replace` puts the message in the cell (the last rule that flags it wins); ruled columns become text and
    keep the cast value where nothing is wrong. `annotate` leaves the data alone and adds `quality_messages`,
    an array of (rule_no, attribute, message).
    """
    usable, types = _usable(df, rules, strict), _source_types(df)
    if mode == "replace":
        return df.withColumns(_replaced(usable, types)) if usable else df
    if mode == "annotate":
        if not usable:
            empty = F.array().cast("array<struct<rule_no:int,attribute:string,message:string>>")
            return df.withColumn("quality_messages", empty)
        return df.withColumn("quality_messages", _findings(usable, types))
    raise ValueError(f"mode must be replace or annotate, not {mode}")


def apply_quality_sets(
    df: DataFrame, rule_sets: Mapping[str, Rules], cumulative: bool = False, strict: bool = False
) -> DataFrame:
    """Every rule set on the whole table, one copy of the rows per set, named in `ruleset`.

    The input is scanned once. With `cumulative`, each set sees the cells as the sets before it left them.
    """
    if cumulative:
        frames, current = [], df
        for name, rules in rule_sets.items():
            current = apply_quality(current, rules, strict=strict)
            frames.append(current.withColumn("ruleset", F.lit(name)))
        return _union_as_text(frames, df.columns)
    types = _source_types(df)
    compiled = {name: _replaced(_usable(df, rules, strict), types) for name, rules in rule_sets.items()}
    ruled = {c for columns in compiled.values() for c in columns}

    def cell(name: str, columns: Mapping[str, Column]) -> Column:
        plain = column(name).cast("string") if name in ruled else column(name)
        return columns.get(name, plain).alias(name)

    copies = [
        F.struct(*[cell(c, columns) for c in df.columns], F.lit(name).alias("ruleset"))
        for name, columns in compiled.items()
    ]
    return df.select(F.inline(F.array(*copies)))


def _union_as_text(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    widened = [
        f.select(*[column(c).cast("string").alias(c) if _differs(frames, c) else column(c) for c in columns], "ruleset")
        for f in frames
    ]
    united = widened[0]
    for f in widened[1:]:
        united = united.unionByName(f)
    return united


def _differs(frames: Sequence[DataFrame], name: str) -> bool:
    return len({f.schema[name].dataType.simpleString() for f in frames}) > 1


def violations(df: DataFrame, rules: Rules, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """One row per flagged cell and rule: keys, rule_no, attribute, message, value (as text)."""
    usable, types = _usable(df, rules, strict), _source_types(df)
    kept = [column(k) for k in keys]
    if not usable:
        none = F.array().cast("array<struct<rule_no:int,attribute:string,message:string,value:string>>")
        return df.select(*kept, F.inline(none))
    return df.select(*kept, F.inline(_findings(usable, types, value=True)))


def quality_summary(df: DataFrame, rules: Rules, strict: bool = False) -> DataFrame:
    """One row per rule: how many cells it flags (0 included). One pass, one aggregate row."""
    usable, types = _usable(df, rules, strict), _source_types(df)
    if not usable:
        return df.sparkSession.createDataFrame([], "rule_no int, attribute string, message string, n_cells long")
    counts = df.agg(
        *[
            F.count_if(quality_condition(r, column(r["attribute"]), types[r["attribute"]])).alias(f"n{i}")
            for i, r in enumerate(usable)
        ]
    )
    rows = [
        F.struct(
            F.lit(r["rule_no"]).alias("rule_no"),
            F.lit(r["attribute"]).alias("attribute"),
            F.lit(r["message"]).alias("message"),
            F.col(f"n{i}").alias("n_cells"),
        )
        for i, r in enumerate(usable)
    ]
    return counts.select(F.inline(F.array(*rows)))
