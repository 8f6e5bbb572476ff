"""Queries that write and read back. Files go to a new folder below the checkpoint folder of the session."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulemill import NestingSpec, Structs, Values, flatten, map_columns, nest, ordinals, search
from rulemill.operators.integrate import found_nothing
from rulemill.operators.transform import apply_transforms, transform_problems
from rulemill.plans.pipeline import recheck_run, run_query, store_run
from rulemill.plans.recheck import recheck, store_findings
from rulemill.plans.rules import problems_frame, read_rules
from rulemill.sources import sinks
from rulemill.sources.catalog import job_catalog, read_folder, rule_catalog
from rulemill.sources.csv import all_text, read_csv, with_file_position
from rulemill.sources.storage import scratch_path
from rulemill.sources.xml import malformed_elements, read_elements, read_xml
from rulemill.streaming.files import process_available, stream_parquet
from rulemill.variants.xml_rules import extract_entities, read_by_rules
from suite.integration import CUSTOMER_PARTY, PARTY_SCHEMA, SUPPLIER_PARTY
from suite.nested import BY_CUSTOMER, HISTORY
from suite.quality import RULE_SETS
from suite.registry import register, table
from suite.variants import ORDER_RULES, order_elements, variant_rows


@register("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def csv_roundtrip(spark, sf):
    """Cells without line breaks, read in splits; `csv_multi_line` has the texts."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(table(spark, sf, "documents").drop("text"), path)
    return read_csv(spark, path, columns=["doc_id", "lang", "source", "n_chars"])


@register("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def csv_multi_line(spark, sf):
    """Whole texts with separators, quotes and line breaks in the cells."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return read_csv(spark, path, columns=["doc_id", "text"], multi_line=True)


@register("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_records_of_one_file(spark, sf):
    """Whole texts in one file, cut at any byte: a range learns from the quotes before it whether it begins inside a cell."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang"), path, files=1)
    return read_csv(spark, path, multi_line=True)


@register("""
SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses,
       string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities
FROM orders GROUP BY o_custkey""")
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    nested = nest(table(spark, sf, "orders"), BY_CUSTOMER, order_by="o_orderkey")
    sinks.write_json(nested, path)
    stored = spark.read.schema(sinks.json_reader_schema(nested)).json(path)
    return stored.select("o_custkey", *[F.array_join(c, ",").alias(c) for c in ("statuses", "priorities")])


@register("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS variant_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'N' || o_orderkey END AS variant_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def xml_file_scan(spark, sf):
    """XML files without line breaks between elements, read back by the closing tag."""
    path = scratch_path(spark, "xml")
    order_elements(spark, sf).write.option("lineSep", "  ").text(path)
    return extract_entities(read_elements(spark, path, "Order"), ORDER_RULES).select("variant_id", "variant_name")


@register("SELECT CAST(o_orderkey AS VARCHAR) AS _key, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) AS status, CAST(count(DISTINCT l_linenumber * 100 + ascii(l_returnflag) + ascii(l_linestatus) * 100000) AS INT) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def xml_declared_schema(spark, sf):
    path = scratch_path(spark, "xml")
    order_elements(spark, sf).write.text(path)
    schema = "_key string, Status string, Lines struct<Line: array<struct<_number: string, _flag: string, _VALUE: string>>>"
    orders = read_xml(spark, path, "Order", schema)
    return orders.select("_key", F.col("Status").alias("status"), F.size("Lines.Line").alias("n_lines"))


@register("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS variant_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'N' || o_orderkey END AS variant_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def xml_row_alternatives(spark, sf):
    """Two rules say what an entity is; only the second one finds any."""
    path = scratch_path(spark, "xml")
    order_elements(spark, sf).write.text(path)
    return read_by_rules(spark, path, [("variation", "", "./Case", "Orders", "", "", ""), *ORDER_RULES]).select("variant_id", "variant_name")


@register("""
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, o_orderkey % 5 = 0 AS malformed
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def xml_malformed(spark, sf):
    """Every fifth order lacks a closing tag: it is left out of the records, and listed."""
    path = scratch_path(spark, "xml")
    cut = F.regexp_extract("xml", 'key="([0-9]+)"', 1)
    broken = F.when(cut.cast("long") % 5 == 0, F.replace("xml", F.lit("</Lines>"))).otherwise(F.col("xml"))
    order_elements(spark, sf).select(broken.alias("xml")).write.text(path)
    read = read_xml(spark, path, "Order", "_key string, Status string").select(F.col("_key").alias("key"), F.col("Status").alias("status"), F.lit(False).alias("malformed"))
    listed = malformed_elements(read_elements(spark, path, "Order"))
    return read.unionByName(listed.select(cut.alias("key"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("malformed")))


TEXTS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text FROM documents"


@register(TEXTS)
def query_result_text(spark, sf):
    """Whole texts, with their line breaks, through a stored query result."""
    base = scratch_path(spark, "results")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    run_query(docs, [("no", None, "doc_id", "integer", "is not null", None)], base)
    return sinks.read_result(spark, base)


@register(TEXTS)
def run_stored_text(spark, sf):
    """Whole texts through a stored run: flat table, then nested JSON."""
    base = scratch_path(spark, "jobs")
    info = sinks.run_metadata(spark, ["documents"], "local", ["documents.parquet"], "doc_id", "all")
    spec = NestingSpec("doc_id", scalars=(("text", "text"),))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    result = store_run(docs, base, "01_02_2023 10_11_12", info, spec=spec, order_by="doc_id")
    job = result.rsplit("/result/", 1)[0]
    return spark.read.schema("doc_id string, text string").json(f"{job}/treated_file.json")


@register("""
WITH runs AS (SELECT n_nationkey, n_name FROM nation)
SELECT 'job_1' AS job, '01_02_2023 10_11_12' AS stamp, '01/02/2023' AS date, '10:11:12' AS time, string_agg(n_name, ', ' ORDER BY n_name) AS sources,
       'local' AS type, 'x.csv' AS "filenames/phenotype", 'nation' AS parameter, CAST(count(*) AS VARCHAR) AS value, 'sizes, names' AS quality_rules FROM runs""")
def run_metadata_stored(spark, sf):
    """The metadata of a stored run, found by the catalog of jobs."""
    base = scratch_path(spark, "jobs")
    names = sorted(r["n_name"] for r in table(spark, sf, "nation").select("n_name").collect())
    info = sinks.run_metadata(spark, names, "local", ["x.csv"], "nation", str(len(names)), ["sizes", "names"])
    sinks.write_run_metadata(info, f"{base}/job_1/result/01_02_2023 10_11_12")
    return job_catalog(spark, base).drop("finished_at", "path")


@register("""
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def folder_many_sources(spark, sf):
    """Twelve sources with three headers in one folder."""
    base = scratch_path(spark, "many")
    orders = (["key", "name", "nation"], ["nation", "key", "name"], ["name", "nation", "key"])
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation")
    for i in range(12):
        sinks.write_csv(rows.where(F.pmod("key", F.lit(12)) == i).select(*orders[i % 3]), f"{base}/source {i}")
    return read_folder(spark, base, orders[0])


@register("""
WITH placed AS (
  SELECT o_custkey, o_orderpriority AS p, CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 < 4 THEN 1 ELSE 2 END * 1000000000000 + o_orderkey AS pos FROM orders
), firsts AS (SELECT o_custkey, p, min(pos) AS pos FROM placed GROUP BY ALL)
SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, arg_max(p, pos) AS last_priority, string_agg(p, ',' ORDER BY pos) AS priorities FROM firsts GROUP BY o_custkey""")
def nest_files_order(spark, sf):
    """Three CSV sources, each larger than the one before; their names say which comes first."""
    base = scratch_path(spark, "ordered")
    orders = table(spark, sf, "orders")
    for i, mine in enumerate(("o_orderkey % 10 = 0", "o_orderkey % 10 BETWEEN 1 AND 3", "o_orderkey % 10 > 3")):
        sinks.write_csv(orders.where(mine).orderBy("o_orderkey").select("o_orderkey", "o_custkey", "o_orderpriority"), f"{base}/source-{i}", files=1)
    rows = with_file_position(read_csv(spark, [f"{base}/source-{i}" for i in range(3)], columns=["o_orderkey", "o_custkey", "o_orderpriority"]))
    spec = NestingSpec("o_custkey", scalars=(("last_priority", "o_orderpriority"),), structs=(Structs("kinds", (("p", "o_orderpriority"),)),))
    nested = nest(rows, spec, order_by="position")
    return nested.select("o_custkey", "last_priority", F.array_join(F.transform("kinds", lambda k: k["p"]), ",").alias("priorities"))


@register("""
WITH rules AS (
  SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_partkey % 4 AS f, p_size % 4 AS s, p_size % 3 AS r, p_size % 2 AS v, p_type, p_size FROM part
), named AS (
  SELECT *, CASE WHEN s = 2 THEN 'gone' WHEN f = 2 AND s = 1 THEN 'size' ELSE 'name' END AS attribute FROM rules
)
SELECT CAST(n AS INT) AS rule_no, attribute, message FROM (
  SELECT n, attribute, CASE
    WHEN attribute = 'gone' THEN 'no column gone'
    WHEN f < 2 AND r = 1 THEN 'the regular expression (' || p_type || ' is not valid: Unclosed group'
    WHEN f = 0 AND r = 0 THEN 'the regular expression is blank'
    WHEN f = 1 AND r = 0 THEN 'the regular expression ' || p_type || ' has no group'
    WHEN f = 2 AND attribute = 'size' THEN 'cannot fill int with x' || v
    WHEN f = 3 THEN 'no column c' || p_size
  END AS message FROM named) WHERE message IS NOT NULL""")
def rule_problems(spark, sf):
    """A transformation-rule table written as CSV, read back and checked, one rule per part."""
    path = scratch_path(spark, "rules")
    rules = table(spark, sf, "part").orderBy("p_partkey").selectExpr(
        "CASE WHEN p_size % 4 = 2 THEN 'gone' WHEN p_partkey % 4 = 2 AND p_size % 4 = 1 THEN 'size' ELSE 'name' END AS attribute",
        "element_at(array('replace', 'extract', 'fill na', 'use values from another attribute'), cast(p_partkey % 4 + 1 as int)) AS function",
        "CASE WHEN p_size % 3 = 1 THEN '(' || p_type WHEN p_size % 3 = 2 THEN '(' || p_type || ')' WHEN p_partkey % 4 = 1 THEN p_type END AS `regular expression`",
        "CASE p_partkey % 4 WHEN 2 THEN 'x' || p_size % 2 WHEN 3 THEN 'c' || p_size END AS replacement",
    )
    sinks.write_csv(rules, path, files=1)
    parts = table(spark, sf, "part").selectExpr("p_name AS name", "p_size AS size")
    return problems_frame(spark, transform_problems(parts, read_rules(spark, path, "transformation")))


@register("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part WHERE p_size > 25 AND p_type = 'PROMO'")
def query_result_stored(spark, sf):
    """Run a rule query, store it under the next number, read the latest back without empty columns."""
    base = scratch_path(spark, "results")
    part = all_text(table(spark, sf, "part")).withColumn("note", F.lit(None).cast("string"))
    rules = [("no", "and", "p_size", "integer", ">", "25"), ("no", None, "p_type", "string", "=", "PROMO")]
    run_query(part, [("no", None, "p_size", "integer", ">", "49")], base, ["p_partkey"])
    run_query(part, rules, base, ["p_partkey", "p_name", "note"])
    return sinks.read_result(spark, base).drop("note")


@register("""
WITH firsts AS (SELECT o_custkey, o_orderstatus AS s, o_orderpriority AS p, min(o_orderkey) AS pos FROM orders GROUP BY ALL)
SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, string_agg(s || ':' || p, ',' ORDER BY s, pos) AS kinds FROM firsts GROUP BY o_custkey""")
def result_export(spark, sf):
    """Export the latest stored result as nested JSON."""
    base, out = scratch_path(spark, "results"), scratch_path(spark, "export")
    orders = table(spark, sf, "orders")
    # Fixed width, so that the order of the text is the order of the keys.
    keyed = orders.withColumn("position", F.format_string("%020d", "o_orderkey"))
    sinks.write_numbered_csv(keyed.select("o_custkey", "o_orderstatus", "o_orderpriority", "position"), base)
    sinks.export_result(spark, base, out, "json", HISTORY, order_by="position")
    shape = nest(sinks.read_result(spark, base), HISTORY, order_by="position")
    stored = spark.read.schema(sinks.json_reader_schema(shape)).json(out)
    shown = F.transform("kinds", lambda k: F.concat_ws(":", k["status"], k["priority"]))
    return stored.select("o_custkey", F.array_join(shown, ",").alias("kinds"))


@register("""
SELECT 'sizes' AS ruleset, p_type, CASE WHEN p_size > 25 THEN 'LARGE' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM
  (SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN 'OFFER' ELSE p_type END AS p_type, CASE WHEN p_size > 25 THEN 26 ELSE p_size END AS p_size FROM part)
UNION ALL
SELECT 'names', p_type, CASE WHEN p_size < 5 THEN 'TINY' ELSE CAST(p_size AS VARCHAR) END FROM
  (SELECT DISTINCT p_type, CASE WHEN p_size < 5 THEN 4 ELSE p_size END AS p_size FROM part)""")
def quality_sets_stored(spark, sf):
    """Every rule set nested and written under its name."""
    path = scratch_path(spark, "quality")
    spec = NestingSpec("p_type", values=(Values("sizes", "p_size"),))
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    sinks.write_quality_sets(part, RULE_SETS, spec, path, order_by="p_partkey")
    stored = spark.read.schema("p_type string, sizes array<string>, ruleset string").json(path)
    return stored.select("ruleset", "p_type", F.explode("sizes").alias("p_size"))


@register("""
SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), NULL FROM supplier""")
def folder_of_sources(spark, sf):
    """Two mapped sources with different headers in one folder."""
    base = scratch_path(spark, "mapped")
    sinks.write_csv(map_columns(table(spark, sf, "customer"), CUSTOMER_PARTY), f"{base}/customers")
    sinks.write_csv(map_columns(table(spark, sf, "supplier"), SUPPLIER_PARTY), f"{base}/suppliers")
    return read_folder(spark, base, PARTY_SCHEMA).drop("acctbal")


@register("""
SELECT ruleset, variant_id, genes FROM (
  SELECT 'genes' AS ruleset, 'v' || o_custkey AS variant_id,
         string_agg(DISTINCT CASE WHEN l_linenumber = 3 THEN 'THIRD' ELSE 'G' || l_linenumber END, ','
                    ORDER BY CASE WHEN l_linenumber = 3 THEN 'THIRD' ELSE 'G' || l_linenumber END) AS genes
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_custkey
  UNION ALL
  SELECT 'starts', 'v' || o_custkey, string_agg(DISTINCT 'G' || l_linenumber, ',' ORDER BY 'G' || l_linenumber)
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_custkey)""")
def run_stored(spark, sf):
    """Search a variant table, store it as a job with two rule sets, read the flagged records back."""
    base = scratch_path(spark, "jobs")
    treated = search(variant_rows(spark, sf).drop("o_orderkey"), "ASSEMBLY", "GRChF")
    info = sinks.run_metadata(spark, ["orders"], "local", ["orders.parquet"], "assembly", "GRChF")
    rule_sets = {
        "genes": [("gene", "string", "no", "equals", "G3", "THIRD")],
        "starts": [("start", "integer", "no", "empty", None, "NO START")],
    }
    result = store_run(treated, base, "01_02_2023 10_11_12", info, rule_sets)
    flagged = spark.read.schema("variant_id string, genes array<string>, ruleset string").json(f"{result}/quality.json")
    return flagged.select("ruleset", "variant_id", F.array_join("genes", ",").alias("genes"))


@register("""
SELECT variant_id, genes FROM (
  SELECT 'v' || o_custkey AS variant_id, string_agg(DISTINCT CASE WHEN l_linenumber = 2 THEN 'SECOND' ELSE 'G' || l_linenumber END, ','
    ORDER BY CASE WHEN l_linenumber = 2 THEN 'SECOND' ELSE 'G' || l_linenumber END) AS genes
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_custkey)""")
def recheck_stored(spark, sf):
    """Other rules for a run that is stored already."""
    base = scratch_path(spark, "jobs")
    treated = search(variant_rows(spark, sf).drop("o_orderkey"), "ASSEMBLY", "GRChF")
    info = sinks.run_metadata(spark, ["orders"], "local", ["orders.parquet"], "assembly", "GRChF")
    store_run(treated, base, "01_02_2023 10_11_12", info)
    result = recheck_run(spark, f"{base}/job_1", "01_02_2023 10_11_12", "02_02_2023 10_11_12", {"second": [("gene", "string", "no", "equals", "G2", "SECOND")]})
    flagged = spark.read.schema("variant_id string, genes array<string>").json(f"{result}/quality.json")
    return flagged.select("variant_id", F.array_join("genes", ",").alias("genes"))


FIRST_RULES = [
    ("l_quantity", "integer", "no", ">", "45", "MANY"), ("l_discount", "double", "no", "range", "(0.09, 0.2)", "CHEAP"),
    ("l_returnflag", "string", "no", "equals", "R", "RETURNED"),
]
LATER_RULES = [
    ("l_returnflag", "string", "no", "equals", "R", "SENT BACK"), ("l_quantity", "integer", "no", ">", "45", "MANY"),
    ("l_tax", "double", "no", "=", "0", "FREE"),
]


@register("""
SELECT l_orderkey, l_linenumber, rule_no, attribute, message FROM (
  SELECT l_orderkey, l_linenumber, 1 AS rule_no, 'l_returnflag' AS attribute, 'SENT BACK' AS message FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, l_linenumber, 2, 'l_quantity', 'MANY' FROM lineitem WHERE trunc(l_quantity) > 45
  UNION ALL SELECT l_orderkey, l_linenumber, 3, 'l_tax', 'FREE' FROM lineitem WHERE l_tax = 0)""")
def recheck_delta(spark, sf):
    """A rule set applied after another one: one rule is evaluated, two are read from what the first has stored."""
    path, lines = scratch_path(spark, "findings"), scratch_path(spark, "lines")
    numbered = ordinals(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"), ["l_orderkey", "l_linenumber"], "row_id")
    numbered.write.parquet(lines)
    stored = spark.read.parquet(lines)
    store_findings(stored, FIRST_RULES, "row_id", path)
    return recheck(stored, LATER_RULES, "row_id", path, ["l_orderkey", "l_linenumber"])


@register("SELECT 'rules of ' || n_name AS name FROM nation")
def rule_catalog_files(spark, sf):
    """Rule files in a folder, one of each nation."""
    path = scratch_path(spark, "rules")
    rules = table(spark, sf, "nation").select(F.concat(F.lit("rules of "), "n_name").alias("file"), F.lit("start;integer;no;empty;;NONE").alias("line"))
    rules.repartition(1).write.partitionBy("file").text(path)
    listed = rule_catalog(spark, path).where(F.col("name").endswith(".txt"))
    return listed.select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("name"))


@register("SELECT v AS status, NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = v) AS nothing FROM (VALUES ('F'), ('O'), ('X'), ('')) s(v)")
def search_found_nothing(spark, sf):
    orders = table(spark, sf, "orders")
    found = [(v, found_nothing(search(orders, "O_ORDERSTATUS", v))) for v in ("F", "O", "X", "")]
    return spark.createDataFrame(found, "status string, nothing boolean")


STREAM_RULES = [("p_name", "replace", "red", "RED"), ("p_brand", "extract", "#([0-9]+)", None)]


@register("SELECT p_partkey, replace(p_name, 'red', 'RED') AS p_name, regexp_extract(p_brand, '#([0-9]+)', 1) AS p_brand FROM part WHERE p_type = 'LARGE'")
def stream_equals_batch(spark, sf):
    """The same transformation and search plan on a file stream."""
    out, checkpoint, source = scratch_path(spark, "stream"), scratch_path(spark, "stream-state"), scratch_path(spark, "parts")
    table(spark, sf, "part").write.parquet(source)
    plan = lambda df: search(apply_transforms(df, STREAM_RULES), "P_TYPE", "LARGE").select("p_partkey", "p_name", "p_brand")
    process_available(stream_parquet(spark, source, table(spark, sf, "part").schema), plan, out, checkpoint)
    return spark.read.schema("p_partkey bigint, p_name string, p_brand string").parquet(out)


@register("""
SELECT s.o_custkey, s.o_orderstatus, p.o_orderpriority
FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) s JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) p
  ON s.o_custkey = p.o_custkey""")
def flatten_stored_json(spark, sf):
    path = scratch_path(spark, "json")
    nested = nest(table(spark, sf, "orders"), BY_CUSTOMER, order_by="o_orderkey")
    sinks.write_json(nested, path)
    return flatten(spark.read.schema(nested.schema).json(path), BY_CUSTOMER)
