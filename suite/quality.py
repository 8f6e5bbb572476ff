"""Quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulemill import apply_quality, apply_quality_sets, quality_summary, violations
from suite.registry import LABELLED, labelled_documents, register, table


@register(f"SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'UNRATED') AS quality FROM {LABELLED}")
def g_empty(spark, sf):
    rules = [("quality", "integer", "no", "empty", None, "UNRATED")]
    return apply_quality(labelled_documents(spark, sf).select("doc_id", "quality"), rules)


@register("""
SELECT p_partkey,
       CASE WHEN p_size >= 40 THEN 'BIG' ELSE CAST(p_size AS VARCHAR) END AS p_size,
       CASE WHEN TRUNC(p_retailprice) < 950 THEN 'CHEAP' ELSE CAST(CAST(TRUNC(p_retailprice) AS INT) AS VARCHAR) END AS p_retailprice
FROM part""")
def g_cmp(spark, sf):
    rules = [
        ("p_size", "integer", "no", ">=", "40", "BIG"),
        ("p_retailprice", "integer", "no", "<", "950", "CHEAP"),
    ]
    return apply_quality(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), rules)


@register("""
SELECT p_partkey,
       CASE WHEN p_size = 7 THEN 'SEVEN' WHEN p_size > 45 THEN 'ABOVE' WHEN p_size <= 3 THEN 'LOW' ELSE CAST(p_size AS VARCHAR) END AS p_size
FROM part""")
def g_operators(spark, sf):
    rules = [
        ("p_size", "short", "no", "<=", "3", "LOW"),
        ("p_size", "short", "no", ">", "45", "ABOVE"),
        ("p_size", "short", "no", "=", "7", "SEVEN"),
    ]
    return apply_quality(table(spark, sf, "part").select("p_partkey", "p_size"), rules)


@register("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'MID' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part")
def g_range(spark, sf):
    rules = [("p_size", "integer", "no", "range", "(10, 20)", "MID")]
    return apply_quality(table(spark, sf, "part").select("p_partkey", "p_size"), rules)


@register("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'REDDISH' ELSE p_name END AS p_name FROM part")
def g_contains(spark, sf):
    rules = [("p_name", "string", "no", "contains", "red", "REDDISH")]
    return apply_quality(table(spark, sf, "part").select("p_partkey", "p_name"), rules)


@register("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CHECK' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def g_equals(spark, sf):
    rules = [("c_mktsegment", "string", "no", "equals", "BUILDING", "CHECK")]
    return apply_quality(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), rules)


@register(f"""
SELECT doc_id, CASE WHEN quality IS NOT NULL AND NOT quality = 1 THEN 'BAD' ELSE CAST(quality AS VARCHAR) END AS quality,
       CASE WHEN NOT contains(source, '1') THEN 'OTHER' ELSE source END AS source,
       CASE WHEN toxic IS NOT NULL THEN 'SEEN' END AS toxic
FROM {LABELLED}""")
def g_not(spark, sf):
    rules = [
        ("quality", "integer", "yes", "=", "1", "BAD"),
        ("source", "string", "yes", "contains", "1", "OTHER"),
        ("toxic", "byte", "yes", "empty", None, "SEEN"),
    ]
    return apply_quality(labelled_documents(spark, sf).select("doc_id", "quality", "source", "toxic"), rules)


@register("""
SELECT p_partkey,
       CASE p_partkey % 3 WHEN 1 THEN 'NOT A NUMBER' ELSE CASE WHEN p_size > 30 THEN 'OVER' ELSE CAST(p_size AS VARCHAR) END END AS code
FROM part""")
def g_malformed(spark, sf):
    """Text cells with fractions and with no number in them."""
    size = F.col("p_size").cast("string")
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit(".7"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name"))
    part = table(spark, sf, "part").select("p_partkey", code.otherwise(size).alias("code"))
    rules = [
        ("code", "integer", "no", "empty", None, "NOT A NUMBER"),
        ("code", "integer", "no", ">", "30", "OVER"),
        ("code", "integer", "no", "no such condition", "1", "IGNORED"),
    ]
    return apply_quality(part, rules)


@register("""
SELECT o_orderkey, CASE WHEN o_custkey > 500 THEN 'HIGH' WHEN o_custkey > 100 THEN 'MID' ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey,
       CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END AS o_orderstatus
FROM orders""")
def g_chain(spark, sf):
    """The last rule that flags a cell gives its message."""
    rules = [
        ("o_custkey", "long", "no", ">", "100", "MID"),
        ("o_custkey", "long", "no", ">", "500", "HIGH"),
        ("o_orderstatus", "string", "no", "equals", "P", "PENDING"),
    ]
    return apply_quality(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), rules)


RULE_SETS = {
    "sizes": [("p_size", "integer", "no", ">", "25", "LARGE"), ("p_type", "string", "no", "equals", "PROMO", "OFFER")],
    "names": [("p_name", "string", "yes", "contains", "bolt", "NO BOLT"), ("p_size", "integer", "no", "<", "5", "TINY")],
}


@register("""
SELECT 'sizes' AS ruleset, p_partkey, p_name, CASE WHEN p_type = 'PROMO' THEN 'OFFER' ELSE p_type END AS p_type,
       CASE WHEN p_size > 25 THEN 'LARGE' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part
UNION ALL
SELECT 'names', p_partkey, CASE WHEN contains(p_name, 'bolt') THEN p_name ELSE 'NO BOLT' END, p_type,
       CASE WHEN p_size < 5 THEN 'TINY' ELSE CAST(p_size AS VARCHAR) END FROM part""")
def g_sets(spark, sf):
    return apply_quality_sets(table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size"), RULE_SETS)


@register("""
SELECT 'sizes' AS ruleset, p_partkey, p_name, CASE WHEN p_type = 'PROMO' THEN 'OFFER' ELSE p_type END AS p_type,
       CASE WHEN p_size > 25 THEN 'LARGE' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part
UNION ALL
SELECT 'names', p_partkey, CASE WHEN contains(p_name, 'bolt') THEN p_name ELSE 'NO BOLT' END,
       CASE WHEN p_type = 'PROMO' THEN 'OFFER' ELSE p_type END,
       CASE WHEN p_size > 25 THEN NULL WHEN p_size < 5 THEN 'TINY' ELSE CAST(p_size AS VARCHAR) END FROM part""")
def g_sets_cumulative(spark, sf):
    """The second set sees the cells of the first; a message is no integer, so it is lost by the cast."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return apply_quality_sets(part, RULE_SETS, cumulative=True)


@register("""
SELECT p_partkey, p_size,
       nullif(concat_ws(',', CASE WHEN p_size >= 30 THEN '1:BIG' END, CASE WHEN contains(p_name, 'blue') THEN '2:BLUE' END,
                             CASE WHEN p_size BETWEEN 35 AND 40 THEN '3:BAND' END), '') AS findings
FROM part""")
def g_annotate(spark, sf):
    rules = [
        ("p_size", "integer", "no", ">=", "30", "BIG"),
        ("p_name", "string", "no", "contains", "blue", "BLUE"),
        ("p_size", "integer", "no", "range", "(35, 40)", "BAND"),
    ]
    noted = apply_quality(table(spark, sf, "part"), rules, mode="annotate")
    shown = F.transform("quality_messages", lambda m: F.concat_ws(":", m["rule_no"].cast("string"), m["message"]))
    return noted.select("p_partkey", "p_size", F.nullif(F.array_join(shown, ","), F.lit("")).alias("findings"))


LINE_RULES = [
    ("l_linenumber", "integer", "no", ">=", "6", "LATE LINE"),
    ("l_quantity", "double", "no", ">", "45.5", "BULK"),
    ("l_returnflag", "string", "yes", "equals", "N", "RETURNED"),
    ("l_discount", "double", "no", "range", "(0.09, 0.1)", "HIGH DISCOUNT"),
]
LINE_CASES = [
    (1, "l_linenumber", "LATE LINE", "l_linenumber >= 6"),
    (2, "l_quantity", "BULK", "l_quantity > 45.5"),
    (3, "l_returnflag", "RETURNED", "NOT (l_returnflag = 'N')"),
    (4, "l_discount", "HIGH DISCOUNT", "l_discount BETWEEN CAST(0.09 AS DOUBLE) AND CAST(0.1 AS DOUBLE)"),
]


@register(" UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, {n} AS rule_no, '{a}' AS attribute, '{m}' AS message FROM lineitem WHERE {w}"
    for n, a, m, w in LINE_CASES))
def g_violations(spark, sf):
    return violations(table(spark, sf, "lineitem"), LINE_RULES, ["l_orderkey", "l_linenumber"]).drop("value")


@register(" UNION ALL ".join(
    f"SELECT {n} AS rule_no, '{a}' AS attribute, '{m}' AS message, count(*) FILTER (WHERE {w}) AS n_cells FROM lineitem"
    for n, a, m, w in LINE_CASES))
def g_summary(spark, sf):
    return quality_summary(table(spark, sf, "lineitem"), LINE_RULES)


BOUNDS = [("l_discount", "=", "0.05"), ("l_discount", ">=", "0.07"), ("l_tax", "<=", "0.02"), ("l_tax", "range", "(0.03, 0.05)")]


@register(" UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, {n} AS rule_no, CAST({c} AS VARCHAR) AS value FROM lineitem WHERE "
    + (f"CAST({c} AS FLOAT) BETWEEN CAST(0.03 AS FLOAT) AND CAST(0.05 AS FLOAT)" if o == "range" else f"CAST({c} AS FLOAT) {o} CAST({v} AS FLOAT)")
    for n, (c, o, v) in enumerate(BOUNDS, 1)))
def g_float_bounds(spark, sf):
    """Text compared with float thresholds, bounds included."""
    keyed = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("string").alias(c) for c in ("l_discount", "l_tax")])
    rules = [(c, "float", "no", o, v, "m") for c, o, v in BOUNDS]
    return violations(keyed, rules, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rule_no", "value")
