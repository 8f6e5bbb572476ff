from functools import lru_cache

import pytest
from pyspark.sql import types as T

from rulemill.plans import rules as rules_module
from rulemill.plans.rules import (
    RuleError, as_rules, check_quality, check_queries, check_transformations, problems_frame, quality_range, query_values,
    read_rules, validate_query_rules,
)
from tests.conftest import values


def test_reading_rules_keeps_order_and_nulls(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("attribute;function;regular expression;replacement\nchromosome;replace;^chr;\nstart;extract;g\\.([0-9]+);\n")
    rules = read_rules(spark, str(path), "transformation")
    assert [(r["rule_no"], r["attribute"], r["replacement"]) for r in rules] == [(1, "chromosome", None), (2, "start", None)]


def test_query_rules_are_named_by_position(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("g;o;p;t;c;v\nyes;and;start;integer;>;100\nno;;gene;string;in;A, B\n")
    assert read_rules(spark, str(path), "query")[0] == {
        "rule_no": 1, "grouping": "yes", "operator": "and", "parameter": "start", "parameter_type": "integer",
        "condition": ">", "value": "100",
    }
    path.write_text("g;o;p\nyes;and;start\n")
    with pytest.raises(RuleError):
        read_rules(spark, str(path), "query")


def test_missing_rule_columns_are_reported(text_frame):
    with pytest.raises(RuleError) as error:
        as_rules(text_frame(["attribute", "type"], [("a", "string")]), "quality")
    assert [a for _, a, _ in error.value.problems] == ["not", "condition", "value", "message"]


def test_rules_must_have_all_values():
    with pytest.raises(RuleError):
        as_rules([("a", "b")], "quality")


def test_any_number_of_rules():
    assert len(as_rules([("a", "b")] * 10_001, "mapping")) == 10_001


def test_transformation_problems_follow_created_columns():
    rules = as_rules(
        [("new", "create empty attribute", None, None), ("new", "fill na", None, "x"), ("old", "create empty attribute", None, None),
         ("gone", "replace", "a", "b"), ("old", "use values from another attribute", None, "gone"), ("gone", "unknown", "a", "b")],
        "transformation",
    )
    assert [(n, a) for n, a, _ in check_transformations(rules, ["old"])] == [(3, "old"), (4, "gone"), (5, "old")]


def test_quality_problems():
    rules = as_rules(
        [("a", "integer", "no", ">", "x", "m"), ("a", "date", "no", ">", "1", "m"), ("b", "string", "no", "equals", "1", "m"),
         ("a", "string", "no", ">", "1", "m"), ("a", "integer", "no", "range", "(1)", "m"), ("a", "integer", "no", "empty", None, "m")],
        "quality",
    )
    assert [n for n, _, _ in check_quality(rules, ["a"])] == [1, 2, 3, 4, 5]
    assert quality_range("(1, 2.5)") is not None and quality_range("1") is None


def test_query_problems():
    rules = as_rules(
        [("maybe", "and", "a", "integer", "=", "1"), ("no", "xor", "a", "integer", "=", "1"), ("no", "and", "b", "string", "=", "1"),
         ("no", "and", "a", "boolean", "<", "true"), ("no", "and", "a", "integer", "between", "1"), ("whatever", None, "a", "boolean", "=", "x")],
        "query",
    )
    assert [n for n, _, _ in check_queries(rules, ["a"])] == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize(
    "condition, value, expected",
    [("between", "1 and 10", ["1", "10"]), ("in", "(A, 'B, x', C)", ["A", "B, x", "C"]), ("in", "'A', \"B\"", ["A", "B"]),
     ("not in", "1,2", ["1", "2"]), ("=", "a, b", ["a, b"])],
)
def test_values_of_a_condition(condition, value, expected):
    assert query_values(condition, value) == expected


def test_validation_marks_every_type_and_condition(text_frame):
    rows = [("no", "and", "p", t, c, "1") for t in ("integer", "string", "boolean", "date") for c in ("=", "<", "LIKE", "is null")]
    checked = validate_query_rules(text_frame(["a", "b", "c", "d", "e", "f"], rows))
    right = {(t, c) for t, c, m in values(checked, "parameter_type", "condition", "message") if m == "Right"}
    assert right == {("integer", "="), ("integer", "<"), ("integer", "is null"), ("string", "="), ("string", "LIKE"), ("string", "is null"), ("boolean", "=")}


def test_problems_as_a_table(spark):
    assert values(problems_frame(spark, [(2, "a", "missing")])) == [(2, "a", "missing")]


@pytest.mark.parametrize(
    "condition, value, expected",
    [("in", "'a, b', c", ["a, b", "c"]), ("in", "it's, don't", ["it's", "don't"]), ("in", '"x,y","z"', ["x,y", "z"]), ("in", "", [""]),
     ("between", "1 And 10", ["1", "10"]), ("between", "1 AND 10", ["1", "10"]), ("between", "sand and land", ["sand", "land"])],
)
def test_quoted_values_and_keywords_in_any_case(condition, value, expected):
    assert query_values(condition, value) == expected


def test_half_filled_query_rules_are_problems(spark):
    from rulemill import query

    frame = spark.createDataFrame([(1, "x")], "start int, g string")
    for half in (("no", None, "g", "string", None, "b"), ("no", None, None, "string", "=", "b"), ("no", None, "g", None, None, None)):
        with pytest.raises(RuleError):
            query(frame, [("no", "and", "start", "integer", ">", "1"), half])
    assert query(frame, [("no", None, "start", "integer", "=", "1"), (None,) * 6, ("", " ", "", "", "", "")]).count() == 1


def test_numeric_rules_on_dates_are_problems(spark):
    from rulemill import query

    frame = spark.sql("SELECT DATE'2020-01-01' AS d, true AS b")
    for name in ("d", "b"):
        with pytest.raises(RuleError, match="does not compare"):
            query(frame, [("no", None, name, "integer", ">", "1")])
        assert query(frame, [("no", None, name, "integer", "is not null", None)]).count() == 1


def test_transformation_rules_that_cannot_be_applied(spark):
    from rulemill.operators.transform import apply_transforms, transform_problems

    frame = spark.createDataFrame([("a", 1), (None, None)], "t string, n int")
    rules = [
        ("t", "replace", "", "X"), ("t", "replace", None, "X"), ("t", "extract", "a", None), ("t", "extract", "(a", None),
        ("n", "fill na", None, "unknown"), ("n", "fill na", None, None), ("n", "fill na", None, "7"), ("t", "fill na", None, "none"),
    ]
    assert [n for n, _, _ in transform_problems(frame, rules)] == [1, 2, 3, 4, 5, 6]
    assert [tuple(r) for r in apply_transforms(frame, rules).collect()] == [("a", 1), ("none", 7)]
    with pytest.raises(RuleError, match="not valid"):
        apply_transforms(frame, rules, strict=True)


def test_equal_patterns_and_fill_values_are_tried_once(spark, monkeypatch):
    compiled, jobs = [], []
    blank = rules_module.pattern_problem.__wrapped__
    monkeypatch.setattr(rules_module, "pattern_problem", lru_cache(lambda pattern, groups: compiled.append(pattern) or blank(pattern, groups)))
    readable = rules_module._readable
    monkeypatch.setattr(rules_module, "_readable", lambda fills: jobs.append(len(fills)) or readable(fills))
    rules = as_rules([r for i in range(500) for r in (("n", "fill na", None, f"x{i % 3}"), ("n", "fill na", None, str(i)), ("s", "extract", "(", None))], "transformation")
    found = check_transformations(rules, {"n": T.IntegerType(), "s": T.StringType()})
    assert [n for n, _, _ in found] == [n for i in range(500) for n in (3 * i + 1, 3 * i + 3)]
    assert found[0] == (1, "n", "cannot fill int with x0") and compiled == ["("] and jobs == [503]
