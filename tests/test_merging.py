import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rulemill import merge_ci, merge_items_ci
from rulemill.functions.arrays import group_items
from rulemill.operators.merging import (
    correlated_children, distinct_on, join_derived, join_on_folder, lookup, new_names, taken_names, with_constant_row,
)
from tests.conftest import values


def test_first_spelling_is_kept_per_key(spark):
    df = spark.createDataFrame([(1, "k", "Flu"), (2, "k", "FLU"), (3, "k", "cold"), (4, "j", "FLU"), (5, "j", None)], "pos int, k string, name string")
    merged = merge_ci(df, ["k"], "name", "pos")
    assert merged.columns == df.columns
    assert values(merge_ci(df, ["k"], "name", "pos", salts=4)) == values(merged)
    assert values(merged, "pos", "name") == [(1, "Flu"), (2, "Flu"), (3, "cold"), (4, "FLU"), (5, None)]


words = st.lists(st.sampled_from(["a", "A", "b", "B", "c", None]), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words)
def test_in_row_merge_equals_a_plain_loop(spark, names):
    expected = {}
    for i, n in enumerate(names):
        if n is not None:
            expected.setdefault(n.lower(), (n, []))[1].append(i)
    df = spark.createDataFrame([([(n, i) for i, n in enumerate(names)],)], "items array<struct<name string, pos int>>")
    row = df.select(merge_items_ci(F.col("items"), "name").alias("m")).first().m
    assert [(g.name, [x.pos for x in g["items"]]) for g in (row or [])] == list(expected.values())


def test_grouping_an_array_keeps_order_and_drops_null_keys(spark):
    df = spark.sql("select array('b1', 'a1', null, 'b2', 'a2', 'b3') v")
    grouped = df.select(group_items(F.col("v"), lambda x: F.substring(x, 1, 1)).alias("g")).first().g
    assert [(g.key, g["items"]) for g in grouped] == [("b", ["b1", "b2", "b3"]), ("a", ["a1", "a2"])]


def test_lookups(spark, text_frame):
    left = text_frame(["assembly", "x"], [("h38", "1"), ("h99", "2"), (None, "3")])
    dates = text_frame(["assembly", "assembly_date"], [("h38", "2013"), ("h37", "2009")])
    assert values(lookup(left, dates, "assembly"), "x", "assembly_date") == [("1", "2013"), ("2", None), ("3", None)]
    one = text_frame(["version"], [("9",)])
    assert values(with_constant_row(left, one), "x", "version") == [("1", "9"), ("2", "9"), ("3", "9")]
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        with_constant_row(left, dates.select("assembly_date")).collect()


def test_names_and_folders(text_frame):
    incoming, existing = text_frame(["name"], [("a",), ("b",)]), text_frame(["name"], [("b",), ("c",)])
    assert values(new_names(incoming, existing)) == [("a",)] and values(taken_names(incoming, existing)) == [("b",)]
    names = text_frame(["path", "dataset"], [("/x/1/databaseName.csv", "one"), ("/x/2/databaseName.csv", "two")])
    files = text_frame(["path"], [("/x/2/data.csv",), ("/x/3/data.csv",)])
    assert values(join_on_folder(names, files), "dataset", "path") == [("two", "/x/2/data.csv")]
    rules, results = text_frame(["rule"], [("query_rule_1",)]), text_frame(["result", "n"], [("query_result_1", "5"), ("query_result_2", "6")])
    assert values(join_derived(rules, results, F.replace("rule", F.lit("rule"), F.lit("result")), "result"), "rule", "n") == [("query_rule_1", "5")]
    assert values(distinct_on(text_frame(["a", "b"], [("1", "x"), ("1", "y")]), ["a"])) == [("1",)]


def test_correlated_children(spark):
    df = spark.sql("select 'p' parent, array(named_struct('k', 'p', 'v', 1), named_struct('k', 'q', 'v', 2), named_struct('k', null, 'v', 3)) kids")
    assert [k.v for k in df.select(correlated_children(F.col("parent"), F.col("kids"), "k").alias("x")).first().x] == [1]
