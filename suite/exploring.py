"""Empty columns, keyword search, paging and row numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulemill import drop_all_null, keyword_search, ordinals, page, page_info, row_ids
from rulemill.operators.explore import keyword_hits
from suite.registry import labelled_documents, register, table


@register("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey = 5 THEN 'x' END AS rare FROM orders")
def drop_empty_columns(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.lit(None).cast("string").alias("empty_text"), "o_orderstatus",
        F.when(F.col("o_orderkey") < -1, 1).alias("empty_number"), F.when(F.col("o_orderkey") == 5, "x").alias("rare"),
    )
    return drop_all_null(orders)


@register("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%red%' OR lower(p_brand) LIKE '%red%'")
def keyword_parts(spark, sf):
    return keyword_search(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "RED")


@register("SELECT doc_id, text FROM documents WHERE contains(lower(text), 'license') OR contains(CAST(doc_id AS VARCHAR), 'license')")
def keyword_documents(spark, sf):
    return keyword_search(table(spark, sf, "documents").select("doc_id", "text"), "License")


WORDS = "(SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS keyword FROM benchmark)"


@register(f"""
SELECT doc_id, 'text' AS "column", keyword FROM documents, {WORDS} WHERE contains(lower(text), lower(keyword))
UNION ALL SELECT doc_id, 'source', keyword FROM documents, {WORDS} WHERE contains(lower(source), lower(keyword))""")
def keyword_hits_of_benchmark(spark, sf):
    """All words of the benchmark at once, in every cell of the documents that contains them."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("keyword"))
    return keyword_hits(table(spark, sf, "documents"), words, ["doc_id"], ["text", "source"])


@register("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_of_orders(spark, sf):
    return page(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], number=3, size=50)


@register("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25 OFFSET 30000""")
def page_deep(spark, sf):
    """A page far behind: its range is found by counting."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return page(lines, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], number=1201, size=25)


@register("SELECT CAST(101 AS BIGINT) AS first_row, CAST(150 AS BIGINT) AS last_row, count(*) AS total_rows FROM orders")
def page_line(spark, sf):
    return page_info(table(spark, sf, "orders"), number=3, size=50)


@register("SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id DESC) AS ordinal FROM documents")
def row_ordinals(spark, sf):
    return ordinals(table(spark, sf, "documents").select("doc_id", "lang"), ["lang", F.desc("doc_id")])


@register("SELECT count(*) AS n, count(*) AS n_ids FROM lineitem")
def unique_row_ids(spark, sf):
    """Ids differ between engines; that there is one per row does not."""
    return row_ids(table(spark, sf, "lineitem").select("l_orderkey")).agg(
        F.count("id").alias("n"), F.count_distinct("id").alias("n_ids")
    )


@register("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def drop_then_keep(spark, sf):
    """Some rows have a label, so only the column without any value goes."""
    labelled = labelled_documents(spark, sf).select("doc_id", "quality")
    return drop_all_null(labelled.withColumn("note", F.lit(None).cast("string")))
