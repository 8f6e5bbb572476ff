"""Query rules, builder trees and free predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulemill import query, query_sql, query_tree, validate_query_rules
from rulemill.operators.rulebook import matches
from rulemill.plans.rules import RULE_COLUMNS
from rulemill.sources.csv import all_text
from suite.registry import LABELLED, labelled_documents, register, table

LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
LINE_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem WHERE "
PART = ["p_partkey", "p_name", "p_type", "p_size"]
PART_SQL = "SELECT p_partkey, p_name, p_type, p_size FROM part WHERE "


@register(LINE_SQL + "l_quantity > 24 AND l_discount <= 0.05 AND l_returnflag <> 'N'")
def q_compare(spark, sf):
    rules = [
        ("no", "and", "l_quantity", "integer", ">", "24"),
        ("no", "and", "l_discount", "double", "<=", "0.05"),
        ("no", None, "l_returnflag", "string", "!=", "N"),
    ]
    return query(table(spark, sf, "lineitem"), rules, LINE)


@register(LINE_SQL + "l_linenumber = 3 AND l_quantity >= 10 AND l_tax < 0.06 AND l_linestatus = 'O'")
def q_equalities(spark, sf):
    rules = [
        ("no", "and", "l_linenumber", "integer", "==", "3"),
        ("no", "and", "l_quantity", "decimal", ">=", "10"),
        ("no", "and", "l_tax", "float", "<", "0.06"),
        ("no", None, "l_linestatus", "string", "=", "O"),
    ]
    return query(table(spark, sf, "lineitem"), rules, LINE)


@register(PART_SQL + "p_size BETWEEN 10 AND 20")
def q_between(spark, sf):
    return query(table(spark, sf, "part"), [("no", None, "p_size", "integer", "between", "10 and 20")], PART)


@register(PART_SQL + "p_size NOT BETWEEN 10 AND 20")
def q_not_between(spark, sf):
    return query(table(spark, sf, "part"), [("no", None, "p_size", "integer", "not between", "10 and 20")], PART)


@register(PART_SQL + "p_size IN (1, 5, 9)")
def q_in_num(spark, sf):
    return query(table(spark, sf, "part"), [("no", None, "p_size", "integer", "in", "(1, 5, 9)")], PART)


@register(PART_SQL + "p_type IN ('ECONOMY', 'LARGE', 'PROMO')")
def q_in_str(spark, sf):
    return query(table(spark, sf, "part"), [("no", None, "p_type", "string", "in", "ECONOMY, 'LARGE', PROMO")], PART)


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2)")
def q_not_in(spark, sf):
    rules = [
        ("no", "and", "c_mktsegment", "string", "not in", "BUILDING, MACHINERY"),
        ("no", None, "c_nationkey", "integer", "not in", "1,2"),
    ]
    return query(table(spark, sf, "customer"), rules, ["c_custkey", "c_mktsegment"])


@register(PART_SQL + "p_name LIKE 'red%' OR p_name LIKE '%_olt'")
def q_like(spark, sf):
    rules = [("no", "or", "p_name", "string", "LIKE", "red%"), ("no", None, "p_name", "string", "like", "%_olt")]
    return query(table(spark, sf, "part"), rules, PART)


@register(f"SELECT doc_id, lang FROM {LABELLED} WHERE quality IS NULL")
def q_null(spark, sf):
    return query(labelled_documents(spark, sf), [("no", None, "quality", "integer", "is null", None)], ["doc_id", "lang"])


@register(f"SELECT doc_id, lang, quality FROM {LABELLED} WHERE quality IS NOT NULL AND lang IS NOT NULL")
def q_not_null(spark, sf):
    rules = [("no", "and", "quality", "integer", "is not null", None), ("no", None, "lang", "string", "is not null", None)]
    return query(labelled_documents(spark, sf), rules, ["doc_id", "lang", "quality"])


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def q_bool(spark, sf):
    orders = table(spark, sf, "orders")
    flag = F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "no").otherwise("?")
    rules = [("no", None, "finished", "boolean", "=", "true")]
    return query(orders.withColumn("finished", flag), rules, ["o_orderkey", "o_orderstatus"])


@register(PART_SQL + "p_size > 25 AND CAST(p_retailprice AS DECIMAL(18, 4)) BETWEEN 950.5 AND 1020.25")
def q_text_numbers(spark, sf):
    """The table as text, as it comes from CSV: the rules say how cells compare."""
    rules = [
        ("no", "and", "p_size", "integer", ">", "25"),
        ("no", None, "p_retailprice", "decimal", "between", "950.5 and 1020.25"),
    ]
    found = query(all_text(table(spark, sf, "part")), rules, PART)
    return found.select(F.col("p_partkey").cast("bigint"), "p_name", "p_type", F.col("p_size").cast("int"))


@register(LINE_SQL + "(l_quantity > 10 AND (l_returnflag = 'R' OR l_discount >= 0.08)) AND l_linenumber < 5")
def q_group_nested(spark, sf):
    rules = [
        ("yes", "and", "l_quantity", "integer", ">", "10"),
        ("yes", "or", "l_returnflag", "string", "=", "R"),
        ("no", "and", "l_discount", "double", ">=", "0.08"),
        ("no", None, "l_linenumber", "integer", "<", "5"),
    ]
    return query(table(spark, sf, "lineitem"), rules, LINE)


@register(LINE_SQL + "l_returnflag = 'R' OR l_quantity > 40 AND l_discount >= 0.05")
def q_precedence(spark, sf):
    rules = [
        ("no", "or", "l_returnflag", "string", "=", "R"),
        ("no", "and", "l_quantity", "integer", ">", "40"),
        ("no", None, "l_discount", "double", ">=", "0.05"),
    ]
    return query(table(spark, sf, "lineitem"), rules, LINE)


@register(LINE_SQL + "l_linenumber = 1 OR (l_quantity < 20 AND (l_returnflag = 'A' OR l_linestatus = 'F'))")
def q_open_at_end(spark, sf):
    """Parentheses still open at the last rule are closed there, whatever its grouping says."""
    rules = [
        ("no", "or", "l_linenumber", "integer", "=", "1"),
        ("yes", "and", "l_quantity", "integer", "<", "20"),
        ("yes", "or", "l_returnflag", "string", "=", "A"),
        ("yes", "and", "l_linestatus", "string", "=", "F"),
    ]
    return query(table(spark, sf, "lineitem"), rules, LINE)


@register(LINE_SQL + " OR ".join(f"l_partkey = {n} AND l_suppkey <> {n}" for n in range(1, 8)))
def q_many_rules(spark, sf):
    """Fourteen rules: order is by position and not by the text of a row number."""
    rules = []
    for n in range(1, 8):
        rules.append(("no", "and", "l_partkey", "integer", "=", str(n)))
        rules.append(("no", "or", "l_suppkey", "integer", "!=", str(n)))
    return query(table(spark, sf, "lineitem"), rules, LINE)


@register("""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 200000.5) AND (o_orderpriority LIKE '%URGENT' OR NOT (o_custkey BETWEEN 100 AND 900))""")
def q_tree_not(spark, sf):
    tree = """
    {"condition": "AND", "not": false, "rules": [
      {"condition": "OR", "not": true, "rules": [
        {"id": "o_orderstatus", "type": "string", "operator": "equal", "value": "F"},
        {"id": "o_totalprice", "type": "double", "operator": "less", "value": 200000.5}]},
      {"condition": "OR", "rules": [
        {"id": "o_orderpriority", "type": "string", "operator": "like", "value": "%URGENT"},
        {"condition": "AND", "not": true, "rules": [
          {"id": "o_custkey", "type": "integer", "operator": "between", "value": [100, 900]}]}]}]}"""
    return query_tree(table(spark, sf, "orders"), tree, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@register(PART_SQL + """
(contains(p_name, 'bolt') OR starts_with(p_name, 'red')) AND NOT ends_with(p_name, 'ring') AND p_type <> '' AND p_size IN (1, 2, 3, 40)""")
def q_tree_text(spark, sf):
    tree = {
        "condition": "AND",
        "rules": [
            {"condition": "OR", "rules": [
                {"id": "p_name", "operator": "contains", "value": "bolt"},
                {"id": "p_name", "operator": "begins_with", "value": "red"}]},
            {"id": "p_name", "operator": "not_ends_with", "value": "ring"},
            {"id": "p_type", "operator": "is_not_empty"},
            {"id": "p_size", "type": "integer", "operator": "in", "value": [1, 2, 3, 40]},
        ],
    }
    return query_tree(table(spark, sf, "part"), tree, PART)


@register("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000 AND o_orderkey % 7 = 3")
def q_sql_where(spark, sf):
    where = "o_orderstatus = 'O' AND o_totalprice > 250000 AND o_orderkey % 7 = 3"
    return query_sql(table(spark, sf, "orders"), where, ["o_orderkey", "o_custkey", "o_orderstatus"])


NUMERIC = "'==', '=', '!=', '<', '>', '<=', '>=', 'between', 'not between', 'is null', 'is not null', 'in', 'not in'"
STRING = "'==', '=', '!=', 'in', 'not in', 'LIKE', 'like', 'is null', 'is not null'"


@register(f"""
WITH rules AS (
  SELECT list_extract(['integer', 'double', 'float', 'decimal', 'string', 'boolean', 'date'], CAST(l_partkey % 7 AS INT) + 1) AS parameter_type,
         list_extract(['==', '=', '!=', '<', 'between', 'is null', 'in', 'not in', 'LIKE', 'like', '~'], CAST(l_suppkey % 11 AS INT) + 1) AS condition
  FROM lineitem)
SELECT parameter_type, condition,
       CASE WHEN parameter_type IN ('integer', 'double', 'float', 'decimal') AND condition IN ({NUMERIC})
              OR parameter_type = 'string' AND condition IN ({STRING})
              OR parameter_type = 'boolean' AND condition IN ('==', '=') THEN 'Right' ELSE 'Wrong Condition' END AS message,
       count(*) AS n
FROM rules GROUP BY ALL""")
def rule_validation(spark, sf):
    """A rule table with one row per line item."""
    types = F.array(*[F.lit(t) for t in ("integer", "double", "float", "decimal", "string", "boolean", "date")])
    conditions = F.array(*[F.lit(c) for c in ("==", "=", "!=", "<", "between", "is null", "in", "not in", "LIKE", "like", "~")])
    lines = table(spark, sf, "lineitem")
    made = {
        "grouping": F.lit("no"),
        "operator": F.lit("and"),
        "parameter": F.lit("p"),
        "parameter_type": F.get(types, (F.col("l_partkey") % 7).cast("int")),
        "condition": F.get(conditions, (F.col("l_suppkey") % 11).cast("int")),
        "value": F.lit("1"),
    }
    rules = lines.select(*[made[n].alias(n) for n in RULE_COLUMNS["query"]])
    return validate_query_rules(rules).groupBy("parameter_type", "condition", "message").agg(F.count(F.lit(1)).alias("n"))


@register(LINE_SQL + "l_quantity > 45 AND l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 2)")
def q_blank_rule(spark, sf):
    rules = [
        ("no", "and", "l_quantity", "integer", ">", "45"),
        ("no", "and", "l_returnflag", "string", "in", "A,R"),
        ("no", None, "l_linenumber", "integer", "in", "1, 2"),
        (None, None, None, None, None, None),
    ]
    return query(table(spark, sf, "lineitem"), rules, LINE)


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS rule, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM orders JOIN lineitem
  ON l_extendedprice >= o_totalprice / 10 AND l_extendedprice < o_totalprice / 10 + 40 AND l_quantity > o_custkey % 40
  AND (o_orderkey % 3 <> 0 OR l_returnflag = CASE WHEN o_orderkey % 2 = 0 THEN 'R' ELSE 'A' END)
GROUP BY o_orderkey""")
def rulebook_lines(spark, sf):
    """One rule for each order, all of them over all lines: the rules are a table, the plan does not grow with them."""
    orders = table(spark, sf, "orders")
    low = F.col("o_totalprice") / 10
    price = F.struct(F.lit("l_extendedprice").alias("attribute"), low.alias("low"), F.lit(True).alias("low_in"), (low + 40).alias("high"), F.lit(False).alias("high_in"), F.lit(None).cast("string").alias("text"))
    none, no = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    quantity = F.struct(F.lit("l_quantity").alias("attribute"), (F.col("o_custkey") % 40).cast("double").alias("low"), F.lit(False).alias("low_in"), none.alias("high"), no.alias("high_in"), F.lit(None).cast("string").alias("text"))
    flag = F.when(F.col("o_orderkey") % 2 == 0, "R").otherwise("A")
    returned = F.struct(F.lit("l_returnflag").alias("attribute"), none.alias("low"), no.alias("low_in"), none.alias("high"), no.alias("high_in"), flag.alias("text"))
    every = F.array_compact(F.array(price, quantity, F.when(F.col("o_orderkey") % 3 == 0, returned)))
    conditions = orders.select(F.col("o_orderkey").cast("string").alias("rule"), F.inline(every))
    return matches(table(spark, sf, "lineitem"), conditions, [], ["l_extendedprice", "l_quantity", "l_returnflag"], {"n": None, "keys": "l_orderkey"})
