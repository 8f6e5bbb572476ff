"""Joins and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulemill.functions.stamps import parse_stamp, result_name, stamp_date, stamp_time, stem
from rulemill.operators.merging import join_derived, join_on_folder, lookup, new_names, taken_names, with_constant_row
from rulemill.sources.catalog import data_files, describe_runs, latest_number, latest_row
from suite.registry import register, table


@register("""
SELECT c_custkey, c_name, n_name, n_regionkey FROM customer
LEFT JOIN nation ON c_nationkey + 5 = n_nationkey""")
def lookup_left(spark, sf):
    """Keys five further on, so that the last five nations are asked for in vain."""
    shifted = table(spark, sf, "customer").withColumn("n_nationkey", F.col("c_nationkey") + 5)
    return lookup(shifted, table(spark, sf, "nation"), "n_nationkey").select("c_custkey", "c_name", "n_name", "n_regionkey")


@register("SELECT o_orderkey, o_custkey, (SELECT max(n_name) FROM nation) AS version FROM orders")
def lookup_const(spark, sf):
    release = table(spark, sf, "nation").agg(F.max("n_name").alias("version"))
    return with_constant_row(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), release)


@register("""
SELECT c_custkey, c_name, replace(c_name, 'Customer', 'Supplier') AS s_name, s_suppkey FROM customer
JOIN supplier ON replace(c_name, 'Customer', 'Supplier') = s_name""")
def derived_key_join(spark, sf):
    derived = F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier"))
    customers, suppliers = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return join_derived(customers, suppliers, derived, "s_name").select("c_custkey", "c_name", "s_name", "s_suppkey")


@register("SELECT replace(c_name, 'Customer', 'Supplier') AS name, c_custkey FROM customer WHERE replace(c_name, 'Customer', 'Supplier') NOT IN (SELECT s_name FROM supplier)")
def anti_new_names(spark, sf):
    incoming = table(spark, sf, "customer").select(F.regexp_replace("c_name", "Customer", "Supplier").alias("name"), "c_custkey")
    return new_names(incoming, table(spark, sf, "supplier").withColumnRenamed("s_name", "name"))


@register("SELECT replace(c_name, 'Customer', 'Supplier') AS name, c_custkey FROM customer WHERE replace(c_name, 'Customer', 'Supplier') IN (SELECT s_name FROM supplier)")
def semi_taken_names(spark, sf):
    incoming = table(spark, sf, "customer").select(F.regexp_replace("c_name", "Customer", "Supplier").alias("name"), "c_custkey")
    return taken_names(incoming, table(spark, sf, "supplier").withColumnRenamed("s_name", "name"))


@register("""
SELECT d.n_name AS dataset, '/raw/' || c_nationkey || '/data_' || c_custkey || '.csv' AS path
FROM customer JOIN nation d ON c_nationkey = d.n_nationkey""")
def folder_join(spark, sf):
    """Name files and data files of one folder, with paths made from keys."""
    names = table(spark, sf, "nation").select(
        F.col("n_name").alias("dataset"), F.concat(F.lit("/raw/"), "n_nationkey", F.lit("/databaseName.csv")).alias("path")
    )
    files = table(spark, sf, "customer").select(
        F.concat(F.lit("/raw/"), "c_nationkey", F.lit("/data_"), "c_custkey", F.lit(".csv")).alias("path")
    )
    return join_on_folder(names, files).select("dataset", "path")


@register("""
SELECT name, folder FROM (
  SELECT CASE o_orderkey % 5 WHEN 0 THEN 'mapping_rules.csv' WHEN 1 THEN 'databaseName.csv' WHEN 2 THEN 'transformation_rules.csv'
              ELSE 'data_' || o_orderkey || '.csv' END AS name,
         CASE WHEN o_custkey % 10 = 0 THEN '/raw/quality_rules' ELSE '/raw/' || o_custkey END AS folder FROM orders)
WHERE name NOT IN ('mapping_rules.csv', 'databaseName.csv', 'transformation_rules.csv') AND folder NOT LIKE '%/quality_rules'""")
def catalog_data_files(spark, sf):
    kind = F.col("o_orderkey") % 5
    name = (
        F.when(kind == 0, "mapping_rules.csv").when(kind == 1, "databaseName.csv").when(kind == 2, "transformation_rules.csv")
        .otherwise(F.concat(F.lit("data_"), "o_orderkey", F.lit(".csv")))
    )
    folder = F.when(F.col("o_custkey") % 10 == 0, "/raw/quality_rules").otherwise(F.concat(F.lit("/raw/"), "o_custkey"))
    return data_files(table(spark, sf, "orders").select(name.alias("name"), folder.alias("folder")))


def result_names(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.concat(F.lit("query_rule_"), "o_orderkey", F.lit(".csv")).alias("name")
    )


@register("SELECT o_orderkey, 'query_result_' || o_orderkey || '.csv' AS result, 'query_rule_' || o_orderkey AS stem FROM orders")
def result_for_rule(spark, sf):
    return result_names(spark, sf).select("o_orderkey", result_name(F.col("name")).alias("result"), stem(F.col("name")).alias("stem"))


@register("SELECT CAST(max(o_orderkey) AS INT) AS latest FROM orders")
def latest_run(spark, sf):
    return latest_number(result_names(spark, sf))


@register("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def latest_run_row(spark, sf):
    return latest_row(result_names(spark, sf), F.regexp_extract("name", r"_(\d+)", 1).try_cast("int")).select("o_orderkey")


STAMP = "strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%d_%m_%Y %H_%M_%S')"


def stamps(spark, sf):
    moment = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400)
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_format(moment, "dd_MM_yyyy HH_mm_ss").alias("stamp"))


@register(f"""
SELECT o_orderkey, {STAMP} AS stamp, strftime(o_orderdate, '%d/%m/%Y') AS date,
       strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%H:%M:%S') AS time,
       CAST(epoch(o_orderdate) + o_orderkey % 86400 AS BIGINT) AS seconds FROM orders""")
def run_stamp_parse(spark, sf):
    s = F.col("stamp")
    return stamps(spark, sf).select(
        "o_orderkey", "stamp", stamp_date(s).alias("date"), stamp_time(s).alias("time"), F.unix_timestamp(parse_stamp(s)).alias("seconds")
    )


@register(f"""
SELECT 'job_' || o_custkey AS job, {STAMP} AS stamp, strftime(o_orderdate, '%d/%m/%Y') AS date, 'local' AS type,
       '/user/jobs/job_' || o_custkey || '/result/' || {STAMP} AS path, 'orders' AS sources FROM orders""")
def run_catalog(spark, sf):
    made = stamps(spark, sf).select(
        F.concat(F.lit("/user/jobs/job_"), "o_custkey", F.lit("/result/"), "stamp", F.lit("/search_info.csv")).alias("path"),
        F.lit("orders").alias("sources"), F.lit("local").alias("type"), F.lit("f").alias("filenames/phenotype"),
        F.lit("p").alias("parameter"), F.lit("v").alias("value"), F.lit("").alias("quality_rules"),
    )
    return describe_runs(made).select("job", "stamp", "date", "type", "path", "sources")
