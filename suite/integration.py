"""Mapping, transformation, union and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulemill import Source, apply_transforms, conform, integrate, map_columns, search, unite
from rulemill.operators.mapping import create_attribute, expand_struct, rename_all, trim_all
from rulemill.sources.csv import all_text
from suite.registry import LABELLED, labelled_documents, register, table

CUSTOMER_MAP = [("cust_id", "c_custkey"), ("name", "c_name"), ("phone", "c_phone"), ("segment", "c_mktsegment")]
PARTY_SCHEMA = ["key", "name", "nation", "acctbal", "segment"]
CUSTOMER_PARTY = [
    ("key", "c_custkey"), ("name", "c_name"), ("nation", "c_nationkey"), ("acctbal", "c_acctbal"),
    ("segment", "c_mktsegment"),
]
SUPPLIER_PARTY = [("key", "s_suppkey"), ("name", "s_name"), ("nation", "s_nationkey"), ("acctbal", "s_acctbal")]


@register("""
SELECT c_custkey AS cust_id, c_name AS name, CAST(NULL AS VARCHAR) AS phone, c_mktsegment AS segment, 'crm' AS origin
FROM customer""")
def map_customer(spark, sf):
    return map_columns(table(spark, sf, "customer"), CUSTOMER_MAP, constants={"origin": "crm"})


@register("""
SELECT s_suppkey, CAST(NULL AS VARCHAR) AS segment, s_name, s_nationkey, s_acctbal FROM supplier""")
def conform_supplier(spark, sf):
    return conform(table(spark, sf, "supplier"), ["s_suppkey", "segment"])


@register("""
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def conform_union_parties(spark, sf):
    customers = map_columns(table(spark, sf, "customer"), CUSTOMER_PARTY)
    suppliers = map_columns(table(spark, sf, "supplier"), SUPPLIER_PARTY)
    return unite([customers, suppliers], PARTY_SCHEMA)


@register("SELECT doc_id, lang, source, n_chars, text FROM documents WHERE lang = 'de'")
def search_lang(spark, sf):
    return search(table(spark, sf, "documents"), "LANG", "de")


@register("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def rename_by_position(spark, sf):
    return rename_all(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["id", "name", "region"])


@register("""
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, trim(p_name) AS p_name, trim(p_brand) AS p_brand FROM part""")
def trim_every_column(spark, sf):
    part = table(spark, sf, "part")
    padded = part.select(
        "p_partkey", F.concat(F.lit("  "), "p_name").alias("p_name"), F.concat("p_brand", F.lit(" ")).alias("p_brand")
    )
    return trim_all(padded)


@register("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def struct_to_columns(spark, sf):
    orders = table(spark, sf, "orders")
    packed = orders.select(
        "o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("s")
    )
    return expand_struct(packed, "s")


@register("""
SELECT p_partkey, regexp_replace(regexp_replace(p_name, ' ', '_', 'g'), '([aeiou])', '<\\1>', 'g') AS p_name FROM part""")
def t_replace(spark, sf):
    rules = [("p_name", "replace", " ", "_"), ("p_name", "replace", "([aeiou])", "<$1>")]
    return apply_transforms(table(spark, sf, "part").select("p_partkey", "p_name"), rules)


@register("""
SELECT p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) AS p_brand,
       CASE WHEN regexp_matches(p_name, '^([a-z]+) b') THEN regexp_extract(p_name, '^([a-z]+) b', 1) ELSE p_name END AS p_name
FROM part""")
def t_extract(spark, sf):
    rules = [("p_brand", "extract", "#([0-9]+)", None), ("p_name", "extract", "^([a-z]+) b", None)]
    return apply_transforms(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), rules)


@register(f"SELECT doc_id, source, coalesce(CAST(quality AS VARCHAR), source) AS quality FROM {LABELLED}")
def t_fallback(spark, sf):
    labelled = labelled_documents(spark, sf).select("doc_id", "source", F.col("quality").cast("string").alias("quality"))
    return apply_transforms(labelled, [("quality", "use values from another attribute", None, "source")])


@register(f"SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'unrated') AS quality, coalesce(toxic, 0) AS toxic FROM {LABELLED}")
def t_fill_na(spark, sf):
    labelled = labelled_documents(spark, sf).select("doc_id", F.col("quality").cast("string").alias("quality"), "toxic")
    return apply_transforms(labelled, [("quality", "fill na", None, "unrated"), ("toxic", "fill na", None, "0")])


@register("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS reviewer FROM nation")
def t_empty_attr(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    # The second rule names a column that exists and is skipped.
    return apply_transforms(nation, [("reviewer", "create empty attribute", None, None), ("n_name", "create empty attribute", None, None)])


@register("SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS reviewer FROM region")
def create_empty_attribute(spark, sf):
    return create_attribute(table(spark, sf, "region").select("r_regionkey", "r_name"), "reviewer")


@register("""
WITH cleaned AS (
  SELECT p_partkey, p_size, p_name, regexp_replace(p_brand, 'Brand', 'B', 'g') AS b FROM part),
numbered AS (
  SELECT *, CASE WHEN regexp_matches(b, '#([0-9])') THEN regexp_extract(b, '#([0-9])', 1) ELSE b END AS digit FROM cleaned)
SELECT p_partkey, CASE WHEN digit = '1' THEN 'one' ELSE replace(digit, '1', 'one') END AS p_brand,
       p_name AS note, p_name AS p_name, 'none' AS grade
FROM numbered""")
def t_chain(spark, sf):
    rules = [
        ("p_brand", "replace", "Brand", "B"),
        ("p_brand", "extract", "#([0-9])", None),
        ("p_brand", "replace", "1", "one"),
        ("note", "create empty attribute", None, None),
        ("note", "use values from another attribute", None, "p_name"),
        ("grade", "create empty attribute", None, None),
        ("grade", "fill na", None, "none"),
        ("absent", "replace", "a", "b"),
        ("p_name", "no such function", "a", "b"),
    ]
    return apply_transforms(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name"), rules)


@register("""
SELECT CAST(c_custkey AS VARCHAR) AS party, lower(c_mktsegment) AS kind, 'customer' AS origin, CAST(NULL AS VARCHAR) AS code
FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL
SELECT CAST(p_partkey AS VARCHAR), 'building', 'part', regexp_extract(p_brand, '#([0-9]+)', 1) FROM part WHERE p_type = 'PROMO'""")
def integrate_sources(spark, sf):
    customers = Source(
        all_text(table(spark, sf, "customer")).withColumn("origin", F.lit("customer")),
        mapping=[("party", "c_custkey"), ("kind", "c_mktsegment"), ("origin", "origin")],
        transforms=[
            ("kind", "replace", "BUILDING", "building"), ("kind", "replace", "AUTOMOBILE", "automobile"),
            ("kind", "replace", "FURNITURE", "furniture"), ("kind", "replace", "HOUSEHOLD", "household"),
            ("kind", "replace", "MACHINERY", "machinery"),
        ],
        name="customer",
    )
    parts = Source(
        all_text(table(spark, sf, "part")).withColumn("origin", F.lit("part")),
        mapping=[("party", "p_partkey"), ("kind", "p_type"), ("origin", "origin"), ("code", "p_brand")],
        transforms=[("kind", "replace", "^PROMO$", "building"), ("code", "extract", "#([0-9]+)", None)],
        name="part",
    )
    return integrate([customers, parts], ["party", "kind", "origin", "code"], "KIND", "building")


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS kind, o_totalprice AS price, CAST(NULL AS INT) AS size FROM orders
UNION ALL SELECT p_name, p_type, p_retailprice, p_size FROM part""")
def union_mixed_types(spark, sf):
    """A number key and a text key become text; columns that one source lacks keep the type of the other."""
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS key", "o_orderstatus AS kind", "o_totalprice AS price")
    parts = table(spark, sf, "part").selectExpr("p_name AS key", "p_type AS kind", "p_retailprice AS price", "p_size AS size")
    return unite([orders, parts])
