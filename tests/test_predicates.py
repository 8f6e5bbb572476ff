import itertools

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rulemill import RuleError, compile_rules, query, query_sql, query_tree
from tests.conftest import values

COLUMNS = ["id", "gene", "start", "note", "flag"]
ROWS = [
    ("1", "A", "5", None, "true"), ("2", "B", "100", "x", "f"), ("3", "O'Neil", "1.7", "y", None), ("4", None, "x", "", "yes"),
    ("5", "C; D", None, "100%", "no"), ("6", "A", "300", "z", "maybe"),
]


@pytest.fixture(scope="module")
def cells(spark):
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.createDataFrame(ROWS, schema)


def ids(df):
    return "".join(sorted(r.id for r in df.select("id").collect()))


def rule(parameter, kind, condition, value, grouping="no", operator="and"):
    return (grouping, operator, parameter, kind, condition, value)


@pytest.mark.parametrize(
    "kind, parameter, condition, value, expected",
    [
        ("integer", "start", ">", "1", "1236"), ("integer", "start", "=", "1", ""), ("integer", "start", "==", "5", "1"),
        ("integer", "start", "!=", "5", "236"), ("integer", "start", "<", "100", "13"), ("integer", "start", "<=", "100", "123"),
        ("decimal", "start", ">=", "1.7", "1236"), ("double", "start", "between", "1.7 and 100", "123"),
        ("float", "start", "not between", "1 and 99", "26"), ("integer", "start", "in", "(5, 300)", "16"),
        ("integer", "start", "not in", "5,300", "23"), ("integer", "start", "is null", None, "5"),
        ("integer", "start", "is not null", None, "12346"), ("string", "gene", "=", "A", "16"), ("string", "gene", "=", "O'Neil", "3"),
        ("string", "gene", "!=", "A", "235"), ("string", "gene", "in", "A, 'B', C; D", "1256"), ("string", "gene", "not in", "A, B", "35"),
        ("string", "gene", "like", "%e%", "3"), ("string", "note", "LIKE", "100\\%", "5"), ("string", "gene", "is null", None, "4"),
        ("string", "gene", "is not null", None, "12356"), ("boolean", "flag", "=", "true", "14"), ("boolean", "flag", "==", "no", "25"),
        ("string", "gene", "=", "A' OR '1'='1", ""),
    ],
)
def test_conditions_on_text(cells, kind, parameter, condition, value, expected):
    assert ids(query(cells, [rule(parameter, kind, condition, value)])) == expected


def test_select_list_and_its_errors(cells):
    assert query(cells, [rule("gene", "string", "=", "B")], ["start", "id"]).columns == ["start", "id"]
    with pytest.raises(RuleError):
        query(cells, [rule("gene", "string", "=", "B")], ["nothing"])


def test_wrong_rules_are_errors(cells):
    for bad in ([rule("gene", "string", "<", "A")], [rule("none", "string", "=", "A")], [rule("start", "integer", "=", "A")], []):
        with pytest.raises(RuleError):
            query(cells, bad)
    with pytest.raises(RuleError):
        query(cells, [rule("id", "integer", "=", "1", grouping="perhaps"), rule("id", "integer", "=", "1")])


def test_blank_rows_are_dropped_and_names_trimmed(cells):
    rules = [(" no", "and ", " gene ", "string ", " = ", " A"), (None,) * 6]
    assert ids(query(cells, rules)) == "16"


def sql_text(rules):
    """The written form the grammar stands for."""
    text, opened = "", 0
    for i, (grouping, operator, parameter, _, condition, value) in enumerate(rules):
        term = f"{parameter} {condition} {value}"
        if i == len(rules) - 1:
            text += term + ")" * opened
        elif grouping == "yes":
            text, opened = text + f"({term} {operator} ", opened + 1
        else:
            text, opened = text + term + ")" * opened + f" {operator} ", 0
    return text


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["yes", "no"]), st.sampled_from(["and", "or"]), st.sampled_from("abc"), st.sampled_from("01")), min_size=1, max_size=14))
def test_grouping_equals_the_written_predicate(spark, shape):
    rules = [(g, o, p, "integer", "=", v) for g, o, p, v in shape]
    bits = spark.createDataFrame(list(itertools.product([0, 1], repeat=3)), "a int, b int, c int")
    assert values(query(bits, rules)) == values(query_sql(bits, sql_text(rules)))


def test_more_than_ten_rules_keep_their_order(spark):
    bits = spark.range(0, 40).select(F.col("id").cast("int").alias("n"))
    rules = [("no", "or", "n", "integer", "=", str(i)) for i in range(12)]
    assert query(bits, rules).count() == 12


def test_tree_with_not_and_nested_groups(cells):
    tree = {"condition": "AND", "not": True, "rules": [
        {"id": "gene", "type": "string", "operator": "equal", "value": "A"},
        {"condition": "OR", "rules": [{"id": "start", "type": "integer", "operator": ">", "value": 100},
                                      {"id": "flag", "type": "boolean", "operator": "equal", "value": False}]}]}
    assert "6" not in ids(query_tree(cells, tree)) and "1" in ids(query_tree(cells, tree))


@pytest.mark.parametrize(
    "operator, value, expected",
    [("contains", "0", "5"), ("not_contains", "0", "2346"), ("begins_with", "1", "5"), ("not_begins_with", "1", "2346"),
     ("ends_with", "%", "5"), ("not_ends_with", "%", "2346"), ("is_empty", None, "4"), ("is_not_empty", None, "2356"),
     ("is_null", None, "1"), ("in", ["x", "y"], "23"), ("not_in", "x,y", "456")],
)
def test_tree_leaves(cells, operator, value, expected):
    leaf = {"id": "note", "type": "string", "operator": operator, "value": value}
    assert ids(query_tree(cells, {"condition": "AND", "rules": [leaf]})) == expected


def test_tree_between_and_errors(cells):
    leaf = {"id": "start", "type": "integer", "operator": "between", "value": [5, 100]}
    assert ids(query_tree(cells, {"condition": "OR", "rules": [leaf]})) == "12"
    for bad in ({"condition": "XOR", "rules": [leaf]}, {"condition": "AND", "rules": []},
                {"condition": "AND", "rules": [{"id": "none", "operator": "equal", "value": 1}]},
                {"condition": "AND", "rules": [{"id": "gene", "type": "string", "operator": ">", "value": 1}]}):
        with pytest.raises(RuleError):
            query_tree(cells, bad)


def test_number_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id as double) d", "cast(id as string) s").write.parquet(path)
    stored = spark.read.parquet(path)
    rules = [rule("id", "integer", ">", "5"), rule("d", "integer", "<", "50"), rule("s", "string", "=", "7")]
    plan = query(stored, rules, ["id"])._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert all(f in pushed for f in ("GreaterThan(id,5)", "LessThan(d,50.0)", "EqualTo(s,7)"))


def test_hundreds_of_rules_compile(cells):
    rules = [rule("id", "integer", "!=", str(1000 + i)) for i in range(400)]
    assert query(cells, rules).count() == len(ROWS)
    assert compile_rules(rules, cells.schema) is not None
