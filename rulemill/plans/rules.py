"""Rule tables: their columns, how they are read, and what is wrong with them.

Rules are small tables written by people, one compiled expression per row. They are the only thing collected to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rulemill.functions.casts import SQL_TYPES, parse_boolean, parse_number
from rulemill.functions.columns import column

# The columns of each kind of rule table.
RULE_COLUMNS = {
    "mapping": ("attribute", "name of column"),
    "xml_mapping": ("elementName", "attrName", "XPath", "rootName", "rootAttr", "ConditionValue", "FixedValue"),
    "transformation": ("attribute", "function", "regular expression", "replacement"),
    "quality": ("attribute", "type", "not", "condition", "value", "message"),
    "query": ("grouping", "operator", "parameter", "parameter_type", "condition", "value"),
}

# Transformation functions.
REPLACE, EXTRACT, CREATE, BORROW, FILL = (
    "replace",
    "extract",
    "create empty attribute",
    "use values from another attribute",
    "fill na",
)

# Which conditions go with which type.
QUALITY_NUMERIC_TYPES = ("integer", "float", "double", "byte", "short", "long", "decimal")
QUALITY_NUMERIC_CONDITIONS = ("empty", ">=", "<=", "<", ">", "=", "range")
QUALITY_STRING_CONDITIONS = ("empty", "contains", "equals")
QUERY_NUMERIC_TYPES = ("integer", "double", "float", "decimal")
QUERY_NUMERIC_CONDITIONS = (
    "==", "=", "!=", "<", ">", "<=", ">=", "between", "not between", "is null", "is not null", "in", "not in",
)
QUERY_STRING_CONDITIONS = ("==", "=", "!=", "in", "not in", "LIKE", "like", "is null", "is not null")
QUERY_BOOLEAN_CONDITIONS = ("==", "=")

RIGHT, WRONG = "Right", "Wrong Condition"

_NOT_NUMBERS = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)

Rule = dict
Rules = DataFrame | Iterable[Mapping | Sequence]
Columns = T.StructType | Mapping[str, T.DataType] | Sequence[str]


class RuleError(ValueError):
    """A rule table that cannot be used; `problems` lists (rule_no, attribute, message)."""

    def __init__(self, problems: list[tuple[int, str | None, str]]):
        self.problems = problems
        super().__init__("; ".join(f"rule {n} ({a}): {m}" for n, a, m in problems))


def read_rules(spark: SparkSession, path: str, kind: str, sep: str = ";", encoding: str = "UTF-8") -> list[Rule]:
    """Read a rule CSV (header, all text). Query rules are named by position, others by header."""
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("encoding", encoding)
    return as_rules(reader.csv(path), kind)


def as_rules(rules: Rules, kind: str) -> list[Rule]:
    """Rules as dicts numbered from 1, in table order. Accepts a DataFrame, dicts or tuples."""
    names = RULE_COLUMNS[kind]
    if isinstance(rules, DataFrame):
        if kind == "query":
            if len(rules.columns) != len(names):
                raise RuleError([(0, None, f"a query rule table has {len(names)} columns, not {len(rules.columns)}")])
            rules = rules.toDF(*names)
        missing = [n for n in names if n not in rules.columns]
        if missing:
            raise RuleError([(0, n, "the rule table lacks this column") for n in missing])
        rows = rules.select(*[column(n).cast("string") for n in names]).collect()
    else:
        rows = [tuple(r.get(n) for n in names) if isinstance(r, Mapping) else tuple(r) for r in rules]
        short = [(i, None, f"expected {len(names)} values") for i, r in enumerate(rows, 1) if len(r) != len(names)]
        if short:
            raise RuleError(short)
    return [{"rule_no": i, **dict(zip(names, r))} for i, r in enumerate(rows, 1)]


def problems_frame(spark: SparkSession, problems: Iterable[tuple[int, str | None, str]]) -> DataFrame:
    """Rule problems as a table, for users who report instead of raise."""
    return spark.createDataFrame(list(problems), "rule_no int, attribute string, message string")


# --- checks -----------------------------------------------------------------------------------


def _types(columns: Columns) -> dict[str, T.DataType | None]:
    """Column types by name; bare names have no known type, those of a schema do."""
    if isinstance(columns, T.StructType):
        return {f.name: f.dataType for f in columns}
    return dict(columns) if isinstance(columns, Mapping) else dict.fromkeys(columns)


def check_transformations(rules: list[Rule], columns: Columns) -> list[tuple[int, str, str]]:
    """Problems of transformation rules, following the columns earlier rules create and the types they leave.

    Equal patterns are compiled once, and all fill values are tried in one job for each type, however many rules there are.
    """
    types, problems = _types(columns), []
    fills: list[tuple[int, str, str, T.DataType]] = []
    for rule in rules:
        number, attribute, function = rule["rule_no"], rule["attribute"], rule["function"]
        report = lambda message, n=number, a=attribute: problems.append((n, a, message))
        if function == CREATE:
            if attribute in types:
                report(f"column {attribute} is there already")
            types[attribute] = T.StringType()
            continue
        if function not in (REPLACE, EXTRACT, BORROW, FILL):
            continue
        if attribute not in types:
            report(f"no column {attribute}")
        elif function in (REPLACE, EXTRACT):
            wrong = pattern_problem(rule["regular expression"], groups=1 if function == EXTRACT else 0)
            if wrong:
                report(wrong)
            else:
                types[attribute] = T.StringType()
        elif function == BORROW and rule["replacement"] not in types:
            report(f"no column {rule['replacement']}")
        elif function == FILL:
            text, target = rule["replacement"], types[attribute]
            if _is_cast(text, target):
                fills.append((number, attribute, text, target))
            elif text is None:
                report(f"cannot fill {target.simpleString() if target else 'a column'} with {text}")
    readable = _readable({(text, target.simpleString()) for _, _, text, target in fills})
    problems += [(n, a, f"cannot fill {t.simpleString()} with {text}") for n, a, text, t in fills if (text, t.simpleString()) not in readable]
    return sorted(problems, key=lambda p: p[0])


@lru_cache(maxsize=1 << 16)
def pattern_problem(pattern: str | None, groups: int) -> str | None:
    """What is wrong with a regular expression, as the engine that will run it sees it."""
    if not pattern:
        return "the regular expression is blank"
    java = SparkSession.active()._jvm.java.util.regex
    try:
        found = java.Pattern.compile(pattern).matcher("").groupCount()
    except Exception as refused:  # the JVM's PatternSyntaxException, in the form the gateway gives it
        reason = re.split(r" near index|\n", str(refused).removeprefix("java.util.regex.PatternSyntaxException: "))[0]
        return f"the regular expression {pattern} is not valid: {reason}"
    return f"the regular expression {pattern} has no group" if found < groups else None


def _is_cast(text: str | None, target: T.DataType | None) -> bool:
    """Whether it takes a cast to fill a column with a text."""
    return text is not None and target is not None and not isinstance(target, T.StringType)


def fill_fits(text: str | None, target: T.DataType | None) -> bool:
    """Whether a fill value can be read as the type of its column."""
    return bool(_readable({(text, target.simpleString())})) if _is_cast(text, target) else text is not None


def _readable(fills: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """Those of some (text, SQL type) of which the text can be read as the type."""
    found = set()
    for sql_type in sorted({t for _, t in fills}):
        texts = SparkSession.active().createDataFrame([(text,) for text, t in sorted(fills) if t == sql_type], "text string")
        found |= {(r["text"], sql_type) for r in texts.where(F.col("text").try_cast(sql_type).isNotNull()).collect()}
    return found


def check_quality(rules: list[Rule], columns: Sequence[str]) -> list[tuple[int, str, str]]:
    problems = []
    for rule in rules:
        number, attribute, rule_type = rule["rule_no"], rule["attribute"], rule["type"]
        if attribute not in columns:
            problems.append((number, attribute, f"no column {attribute}"))
        if rule_type not in QUALITY_NUMERIC_TYPES and rule_type != "string":
            problems.append((number, attribute, f"unknown type {rule_type}"))
        elif not quality_rule_applies(rule):
            problems.append((number, attribute, f"condition {rule['condition']} is not for {rule_type}"))
        elif rule["condition"] == "range" and quality_range(rule["value"]) is None:
            problems.append((number, attribute, f"range {rule['value']} is not (lower, upper)"))
        elif rule["condition"] in (">=", "<=", "<", ">", "=") and parse_number(rule["value"]) is None:
            problems.append((number, attribute, f"{rule['value']} is not a number"))
    return problems


def quality_rule_applies(rule: Rule) -> bool:
    if rule["type"] == "string":
        return rule["condition"] in QUALITY_STRING_CONDITIONS
    return rule["type"] in QUALITY_NUMERIC_TYPES and rule["condition"] in QUALITY_NUMERIC_CONDITIONS


def quality_range(text: str | None) -> tuple | None:
    """`(1, 10)` -> the two bounds, or None."""
    bounds = [parse_number(p) for p in (text or "").replace("(", "").replace(")", "").split(",")]
    return tuple(bounds) if len(bounds) == 2 and None not in bounds else None


def check_queries(rules: list[Rule], columns: Columns) -> list[tuple[int, str, str]]:
    types, problems = _types(columns), []
    for rule in rules:
        number, parameter, rule_type = rule["rule_no"], rule["parameter"], rule["parameter_type"]
        condition, last = rule["condition"], rule is rules[-1]
        if parameter not in types:
            problems.append((number, parameter, f"no column {parameter}"))
        elif rule_type in QUERY_NUMERIC_TYPES and isinstance(types[parameter], _NOT_NUMBERS) and condition not in ("is null", "is not null"):
            problems.append((number, parameter, f"{types[parameter].simpleString()} column {parameter} does not compare as {rule_type}"))
        if not query_condition_fits(rule_type, condition):
            problems.append((number, parameter, WRONG))
            continue
        if not last:
            if rule["grouping"] not in ("yes", "no"):
                problems.append((number, parameter, f"grouping must be yes or no, not {rule['grouping']}"))
            if (rule["operator"] or "").lower() not in ("and", "or"):
                problems.append((number, parameter, f"operator must be and or or, not {rule['operator']}"))
        if not _query_value_fits(rule_type, condition, rule["value"]):
            problems.append((number, parameter, f"{rule['value']} does not fit {rule_type} {condition}"))
    return problems


def query_condition_fits(rule_type: str | None, condition: str | None) -> bool:
    if rule_type in QUERY_NUMERIC_TYPES:
        return condition in QUERY_NUMERIC_CONDITIONS
    if rule_type == "string":
        return condition in QUERY_STRING_CONDITIONS
    return rule_type == "boolean" and condition in QUERY_BOOLEAN_CONDITIONS


def query_values(condition: str, value) -> list[str]:
    """The values of one rule: two for between, any number for in, otherwise one."""
    if isinstance(value, (list, tuple)):
        return [str(v) for v in value]
    text = "" if value is None else str(value)
    if condition in ("between", "not between"):
        low, high, *_ = [*re.split(r"\s+and\s+", text, maxsplit=1, flags=re.IGNORECASE), ""]
        return [low.strip(), high.strip()]
    if condition in ("in", "not in"):
        listed = text.strip()
        if listed.startswith("(") and listed.endswith(")"):
            listed = listed[1:-1]
        return [_unquote(v.strip()) for v in _LISTED.findall(listed)] if listed else [""]
    return [text]


#: One value of a list: commas within quotes belong to it. A quote that opens no quoted value is an ordinary character.
_LISTED = re.compile(r"""(?:^|(?<=,))(\s*'[^']*'\s*(?=,|$)|\s*"[^"]*"\s*(?=,|$)|[^,]*)(?:,|$)""")


def _unquote(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _query_value_fits(rule_type: str, condition: str, value) -> bool:
    if condition in ("is null", "is not null"):
        return True
    if value is None:
        return False
    values = query_values(condition, value)
    if rule_type in QUERY_NUMERIC_TYPES:
        return all(parse_number(v) is not None for v in values)
    return rule_type != "boolean" or parse_boolean(values[0]) is not None


def is_blank_query(rule: Rule) -> bool:
    """A row of blank cells, such as a trailing empty line. A rule that is filled in half is a problem, not a blank."""
    return all(not str(rule[c] or "").strip() for c in RULE_COLUMNS["query"])


def trimmed(rule: Rule) -> Rule:
    return {k: v.strip() if isinstance(v, str) else v for k, v in rule.items()}


def validate_query_rules(rules: DataFrame) -> DataFrame:
    """The rule table with a `message` column: Right, or Wrong Condition for a type/condition mismatch."""
    named = rules.toDF(*RULE_COLUMNS["query"]) if len(rules.columns) == 6 else rules
    kind, condition = F.col("parameter_type"), F.col("condition")
    fits = (
        (kind.isin(*QUERY_NUMERIC_TYPES) & condition.isin(*QUERY_NUMERIC_CONDITIONS))
        | ((kind == "string") & condition.isin(*QUERY_STRING_CONDITIONS))
        | ((kind == "boolean") & condition.isin(*QUERY_BOOLEAN_CONDITIONS))
    )
    return named.withColumn("message", F.when(fits, RIGHT).otherwise(WRONG))


assert set(QUALITY_NUMERIC_TYPES) <= set(SQL_TYPES)
