import pytest
from pyspark.sql import functions as F, types as T

from rulemill.functions.casts import comparable, number_literal, parse_boolean, parse_number, tolerant_cast


def cast_one(spark, text, rule_type):
    df = spark.createDataFrame([(text,)], "v string")
    return df.select(tolerant_cast(F.col("v"), rule_type, T.StringType()).alias("v")).first()[0]


@pytest.mark.parametrize(
    "text, rule_type, expected",
    [
        ("12", "integer", 12), ("1.7", "integer", 1), ("-1.7", "integer", -1), (" 5 ", "integer", 5), ("x", "integer", None),
        ("", "integer", None), (None, "integer", None), ("1e2", "integer", None), ("1E2", "long", None),
        ("3000000000", "integer", None), ("3000000000", "long", 3000000000), ("300", "byte", None), ("127", "byte", 127),
        ("40000", "short", None), ("1.5", "double", 1.5), ("1e2", "double", 100.0), ("abc", "double", None),
        ("9223372036854775807", "long", 9223372036854775807), ("1", "boolean", True), ("no", "boolean", False),
        ("maybe", "boolean", None), ("x", "string", "x"),
    ],
)
def test_text_cells(spark, text, rule_type, expected):
    assert cast_one(spark, text, rule_type) == expected


def test_bare_decimal_rounds_to_whole_numbers(spark):
    assert [str(cast_one(spark, t, "decimal")) for t in ("1.5", "2.4", "12345678901", "x")] == ["2", "2", "None", "None"]


def test_numbers_and_other_types_are_cast_without_errors(spark):
    df = spark.createDataFrame([(1.7, 3000000000, True)], "d double, l long, b boolean")
    cast = df.select(
        tolerant_cast(F.col("d"), "integer", T.DoubleType()).alias("d"),
        tolerant_cast(F.col("l"), "integer", T.LongType()).alias("l"),
        tolerant_cast(F.col("b"), "integer", T.BooleanType()).alias("b"),
    ).first()
    assert tuple(cast) == (1, None, None)


def test_integer_rules_compare_text_exactly(spark):
    df = spark.createDataFrame([("1.7",), ("1",), ("x",)], "v string")
    above = df.where(comparable(F.col("v"), "integer", T.StringType()) > 1)
    assert [r.v for r in above.collect()] == ["1.7"]


def test_number_columns_are_compared_as_they_are(spark):
    plan = spark.range(5).where(comparable(F.col("id"), "integer", T.LongType()) > number_literal(parse_number("3"), T.LongType()))
    assert "cast" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_parsing_of_rule_values():
    assert parse_number(" 1.50 ") is not None and parse_number("x") is None and parse_number("NaN") is None
    assert parse_boolean("TRUE") is True and parse_boolean("f") is False and parse_boolean("2") is None
