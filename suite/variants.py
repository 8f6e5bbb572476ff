"""Variant records: XML made from orders, extraction by layout and by rules, derived attributes, nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulemill import Group, NestingSpec, Structs, apply_transforms, flatten, flatten_branch, nest
from rulemill.operators.mapping import conform
from rulemill.variants.clinvar import extract_variants, of_phenotype
from rulemill.variants.derive import (
    CLEANING_RULES, clinical_actionability, derive_attributes, variant_name, with_assembly_dates,
)
from rulemill.variants.schema import VARIANT_COLUMNS, VARIANT_SPEC
from rulemill.sources.storage import scratch_path
from rulemill.variants.xml_rules import extract_entities, read_by_rules
from suite.nested import order_lines
from suite.registry import register, table

SIGNIFICANCE = ("Pathogenic", "benign", "Drug Response", "VUS", "unknown to all")


def release_elements(spark, sf):
    """One variation element per order; which parts it has depends on the order key."""
    k, c = F.col("o_orderkey"), F.col("o_orderkey") % 22 + 1
    genomic = F.format_string("NC_%06d.11:g.%dA&gt;T", c, k)
    located = F.format_string(
        '<Location><SequenceLocation Assembly="GRCh38" Chr="%d" start="%d" stop="%d" referenceAlleleVCF="A" '
        'alternateAlleleVCF="G"/><SequenceLocation Assembly="GRCh37" Chr="%d" display_start="%d" display_stop="%d"/>'
        "</Location><CanonicalSPDI>NC_%06d.10:%d:C:T</CanonicalSPDI>",
        c, k + 100, k + 101, c, k, k + 1, c, k,
    )
    expressed = F.concat(
        F.lit('<HGVSlist><HGVS><NucleotideExpression Assembly="GRCh38"><Expression>'), genomic,
        F.lit("</Expression></NucleotideExpression></HGVS><HGVS><NucleotideExpression><Expression>NM_"),
        k.cast("string"), F.lit("</Expression></NucleotideExpression></HGVS></HGVSlist>"),
    )
    banded = F.format_string("<Location><CytogeneticLocation>%dp13.12</CytogeneticLocation></Location>", c)
    allele = F.when(k % 4 == 0, located).when(k % 4 == 2, expressed).when(k % 4 == 3, banded).otherwise(F.lit(""))
    name = F.when(k % 4 == 1, F.concat(genomic, F.lit(" (x)"))).otherwise(F.lit("NM_0"))
    said = F.get(F.array(*[F.lit(s) for s in SIGNIFICANCE]), (k % 5).cast("int"))
    assertion = (
        '<ClinicalAssertion ID="%s"><ReviewStatus>%s</ReviewStatus><Interpretation><Description>%s</Description>'
        "</Interpretation><AttributeSet><Attribute Type=\"AssertionMethod\">ACMG</Attribute><Attribute Type=\"Other\">z"
        "</Attribute></AttributeSet>%s</ClinicalAssertion>"
    )
    stated = F.when(k % 10 == 0, "<TraitSet><Trait><Name><ElementValue>Stated</ElementValue></Name></Trait></TraitSet>")
    stated = stated.otherwise("")
    assertions = F.concat(
        F.format_string(assertion, F.concat(F.lit("a"), k), F.lit("first"), said, stated),
        F.format_string(assertion, F.concat(F.lit("b"), k), F.lit("second"), said, F.lit("")),
    )
    mapping = F.format_string(
        '<TraitMapping ClinicalAssertionID="a%d"><MedGen Name="Trait, %d"/></TraitMapping>'
        '<TraitMapping ClinicalAssertionID="b%d"><MedGen Name="TRAIT, %d"/></TraitMapping>',
        k, k % 7, k, k % 7,
    )
    mapped = F.when(k % 10 == 0, "").otherwise(mapping)
    xml = F.concat(
        F.format_string('<Variation VariationID="%d" Accession="VCV%d" VariationName="%s" VariationType="SNV">', k, k, name),
        F.lit("<InterpretedRecord><SimpleAllele><GeneList><Gene Symbol=\"G"), (k % 9).cast("string"),
        F.lit('"/></GeneList>'), allele, F.lit("</SimpleAllele><ClinicalAssertionList>"), assertions,
        F.lit("</ClinicalAssertionList><TraitMappingList>"), mapped,
        F.lit("</TraitMappingList></InterpretedRecord></Variation>"),
    )
    # Parsing costs far more than moving the keys, so all cores get some of it however the table is laid out.
    keys = table(spark, sf, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism)
    return keys.select(xml.alias("xml"))


RELEASE_SQL = """
WITH base AS (
  SELECT o_orderkey AS k, o_orderkey % 22 + 1 AS c, o_orderkey % 4 AS kind,
         list_extract(['Pathogenic', 'benign', 'Drug Response', 'VUS', 'unknown to all'], CAST(o_orderkey % 5 AS INT) + 1) AS sig
  FROM orders),
asm AS (
  SELECT k, 'GRCh38' AS assembly, k + 100 AS s, k + 101 AS e, 'A' AS ref, 'G' AS alt FROM base WHERE kind = 0
  UNION ALL SELECT k, 'GRCh37', k, k + 1, 'C', 'T' FROM base WHERE kind = 0
  UNION ALL SELECT k, 'GRCh38', k, k, NULL, NULL FROM base WHERE kind = 2),
hg AS (
  SELECT k, 'NC_' || lpad(CAST(c AS VARCHAR), 6, '0') || '.11:g.' || k || 'A>T' AS hgvs FROM base WHERE kind = 2
  UNION ALL SELECT k, 'NM_' || k FROM base WHERE kind = 2),
ph AS (
  SELECT k, 'Trait ' || (k % 7) AS phenotype, 'first' AS level FROM base WHERE k % 10 <> 0
  UNION ALL SELECT k, 'Trait ' || (k % 7), 'second' FROM base WHERE k % 10 <> 0
  UNION ALL SELECT k, 'Stated', 'first' FROM base WHERE k % 10 = 0)
SELECT 'VCV' || b.k AS variant_id, CAST(c AS VARCHAR) AS chromosome, 'G' || (b.k % 9) AS gene, hgvs, assembly,
       CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end", ref, alt, phenotype, level AS level_certainty,
       sig AS clinical_significance, 'ACMG' AS assertion_criteria, '7' AS version,
       CASE b.k % 5 WHEN 0 THEN 'Disorder causing or risk factor' WHEN 1 THEN 'Not disorder causing or protective effect'
         WHEN 2 THEN 'Affects drugs or treatment response' WHEN 3 THEN 'Uncertain role' ELSE 'Not provided' END AS clinical_actionability,
       CASE WHEN ref IS NOT NULL THEN 'Chr' || c || ':g.' || s || '-' || e || ':' || ref || '>' || alt || '(' || assembly || ')'
            ELSE 'Chr' || c || ':ImpreciseVariant' END AS variant_name
FROM base b LEFT JOIN asm ON asm.k = b.k LEFT JOIN hg ON hg.k = b.k LEFT JOIN ph ON ph.k = b.k"""

SHOWN = [
    "variant_id", "chromosome", "gene", "hgvs", "assembly", "start", "end", "ref", "alt", "phenotype", "level_certainty",
    "clinical_significance", "assertion_criteria", "version", "clinical_actionability", "variant_name",
]


@register(RELEASE_SQL)
def release_variants(spark, sf):
    records = extract_variants(release_elements(spark, sf), F.lit("7"))
    return derive_attributes(flatten(records, VARIANT_SPEC)).select(*[F.col(f"`{c}`") for c in SHOWN])


@register(f"SELECT variant_id, phenotype, level_certainty FROM ({RELEASE_SQL}) WHERE phenotype = 'Trait 3'")
def release_of_phenotype(spark, sf):
    records = of_phenotype(extract_variants(release_elements(spark, sf)), "trait, 3")
    flat = derive_attributes(flatten(records, VARIANT_SPEC))
    return flat.select("variant_id", "phenotype", "level_certainty")


@register("""
SELECT 'v' || l_orderkey AS variant_id, 'GRCh' || (35 + l_linenumber) AS assembly,
       r_name AS assembly_date
FROM lineitem LEFT JOIN region ON l_linenumber - 1 = r_regionkey""")
def assembly_dates(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("v"), "l_orderkey").alias("variant_id"),
        F.concat(F.lit("GRCh"), (F.col("l_linenumber") + 35).cast("string")).alias("assembly"),
        F.lit(None).cast("string").alias("assembly_date"),
    )
    dates = table(spark, sf, "region").select(
        F.concat(F.lit("GRCh"), (F.col("r_regionkey") + 36).cast("string")).alias("assembly"), F.col("r_name").alias("assembly_date")
    )
    return with_assembly_dates(lines, dates)


@register("""
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_linenumber = 7 THEN 'Chr' || (l_suppkey % 22 + 1) || ':ImpreciseVariant'
            WHEN l_linenumber = 6 THEN NULL
            ELSE 'Chr' || (l_suppkey % 22 + 1) || ':g.' || l_partkey || '-' || (l_partkey + 1) || ':' || l_returnflag || '>' || l_linestatus || '(GRCh38)' END AS variant_name
FROM lineitem""")
def n_variant_name(spark, sf):
    line = F.col("l_linenumber")
    name = variant_name(
        (F.col("l_suppkey") % 22 + 1).cast("string"),
        F.when(line != 7, F.col("l_partkey").cast("string")),
        (F.col("l_partkey") + 1).cast("string"),
        F.col("l_returnflag"),
        F.col("l_linestatus"),
        F.when(line != 6, F.lit("GRCh38")),
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", name.alias("variant_name"))


STATED = (
    "Pathogenic", "pathologic", "LIKELY PATHOGENIC", "risk factor", "Affects", "association", "Benign", "likely benign",
    "association not found", "protective", "drug response", "confers sensitivity", "VUS", "Uncertain significance",
    "conflicting data from submitters", "something else",
)


@register(f"""
WITH s AS (SELECT list_extract({list(STATED)}, CAST(l_partkey % 17 AS INT) + 1) AS sig, l_partkey % 17 AS i FROM lineitem)
SELECT sig, CASE WHEN i < 6 THEN 'Disorder causing or risk factor' WHEN i < 10 THEN 'Not disorder causing or protective effect'
                 WHEN i < 12 THEN 'Affects drugs or treatment response' WHEN i < 15 THEN 'Uncertain role' ELSE 'Not provided' END AS actionability,
       count(*) AS n
FROM s GROUP BY ALL""")
def n_actionability(spark, sf):
    listed = F.get(F.array(*[F.lit(s) for s in STATED]), (F.col("l_partkey") % 17).cast("int"))
    said = table(spark, sf, "lineitem").select(listed.alias("sig"))
    return said.groupBy("sig", clinical_actionability(F.col("sig")).alias("actionability")).agg(F.count(F.lit(1)).alias("n"))


@register("""
SELECT o_orderkey, 'a b' AS phenotype, CASE WHEN o_orderkey % 3 = 0 THEN 'G.' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS start,
       CAST(o_custkey AS VARCHAR) AS "end", 'A' AS ref, CASE WHEN o_orderkey % 2 = 0 THEN 'G' ELSE '7' END AS alt, 'T' AS risk_allele,
       CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey % 22 + 1 AS VARCHAR) WHEN 1 THEN CAST(o_custkey % 22 + 1 AS VARCHAR) ELSE 'X' END AS chromosome
FROM orders""")
def n_regexes(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 22 + 1
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.lit("a, b").alias("phenotype"),
        F.when(k % 3 == 0, F.concat(F.lit("G."), k)).otherwise(F.format_string("NC_000001.10:g.%dC>T", k)).alias("start"),
        F.col("o_custkey").cast("string").alias("end"),
        F.format_string("NC_000019.10:%d:A:G", k).alias("ref"),
        F.when(k % 2 == 0, F.format_string("NC_000019.10:%d:A:CG", k)).otherwise("7").alias("alt"),
        F.lit("x:T").alias("risk_allele"),
        F.when(k % 3 == 0, F.format_string("%dp13.12", c)).when(k % 3 == 1, F.format_string("NC_%06d.10:g.1A>T", c))
        .otherwise("Xq28").alias("chromosome"),
    )
    return apply_transforms(raw, CLEANING_RULES)


def variant_rows(spark, sf):
    """A wide variant table: one variant per customer, children from orders and their lines."""
    rows = order_lines(spark, sf)
    made = rows.select(
        F.concat(F.lit("v"), "o_custkey").alias("variant_id"),
        F.concat(F.lit("G"), (F.col("l_linenumber")).cast("string")).alias("gene"),
        F.concat(F.lit("GRCh"), "o_orderstatus").alias("assembly"),
        F.col("o_orderkey").cast("string").alias("start"),
        F.col("o_orderpriority").alias("phenotype"),
        F.col("l_returnflag").alias("clinical_significance"),
        F.when(F.col("l_returnflag") == "A", F.lit("method")).alias("method"),
        F.col("l_linestatus").alias("classification"),
        F.lit("bank").alias("name"),
        F.col("o_custkey").cast("string").alias("databanks_variant_id"),
        "o_orderkey",
    )
    return conform(made, VARIANT_COLUMNS)


@register("""
SELECT 'v' || o_custkey AS variant_id, string_agg(DISTINCT 'G' || l_linenumber, ',' ORDER BY 'G' || l_linenumber) AS genes,
       count(DISTINCT o_orderkey) AS n_assemblies, count(DISTINCT o_orderpriority) AS n_phenotypes, CAST(1 AS BIGINT) AS n_databanks
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def variant_records(spark, sf):
    nested = nest(variant_rows(spark, sf), VARIANT_SPEC, order_by="o_orderkey")
    sizes = {"n_assemblies": "assembly", "n_phenotypes": "phenotypes", "n_databanks": "databanks"}
    return nested.select(
        "variant_id", F.array_join("genes", ",").alias("genes"),
        *[F.size(c).cast("bigint").alias(n) for n, c in sizes.items()],
    )


@register("""
SELECT DISTINCT 'v' || o_custkey AS variant_id, o_orderpriority AS phenotype, l_returnflag AS clinical_significance,
       CASE WHEN l_returnflag = 'A' THEN 'method' END AS method
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def variant_interpretations(spark, sf):
    nested = nest(variant_rows(spark, sf), VARIANT_SPEC, order_by="o_orderkey")
    flat = flatten_branch(nested, VARIANT_SPEC_PHENOTYPES, "phenotypes")
    return flat.select("variant_id", "phenotype", "clinical_significance", "method")


VARIANT_SPEC_PHENOTYPES = NestingSpec("variant_id", groups=VARIANT_SPEC.groups)

ORDER_RULES = [
    ("variation", "", "./Order", "Orders", "", "", ""),
    ("variation", "variant_id", "", "Order", "key", "", ""),
    ("variation", "variant_name", "./Status", "Order", "", "", ""),
    ("variation", "variant_name", "./Note", "Order", "code", "", ""),
    ("assembly", "", "./Lines/Line[@flag='A']", "Order", "", "", ""),
    ("assembly", "assembly", "", "Line", "number", "", ""),
    ("assembly", "ref", "", "Line", "", "", ""),
    ("databank", "", "./Note", "Order", "", "", ""),
    ("databank", "name", "", "Note", "", "", "orders"),
    ("phenotype", "", "./Kind", "Order", "", "", ""),
    ("phenotype", "phenotype", "./Name", "Kind", "", "", ""),
    ("kindKey", "", "", "Kind", "flag", "", ""),
    ("interpretation", "", "./Lines/Line[@flag='<value>']", "Order", "", "kindKey", ""),
    ("interpretation", "clinical_significance", "", "Line", "number", "", ""),
]


def order_elements(spark, sf):
    """Orders with their lines and return-flag kinds as XML."""
    spec = NestingSpec(
        "o_orderkey", scalars=(("o_orderstatus", "o_orderstatus"),),
        structs=(Structs("lines", (("n", "l_linenumber"), ("flag", "l_returnflag"), ("status", "l_linestatus"))),),
        groups=(Group("kinds", ("flag", "l_returnflag")),),
    )
    nested = nest(order_lines(spark, sf), spec, order_by="o_orderkey")
    line = F.transform(
        "lines", lambda x: F.format_string('<Line number="%d" flag="%s">%s</Line>', x["n"], x["flag"], x["status"])
    )
    kind = F.transform("kinds", lambda x: F.format_string('<Kind flag="%s"><Name>kind %s</Name></Kind>', x["flag"], x["flag"]))
    status = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<Status>"), "o_orderstatus", F.lit("</Status>")))
    note = F.when(F.col("o_orderkey") % 3 == 0, F.format_string('<Note code="N%d"/>', F.col("o_orderkey")))
    xml = F.concat(
        F.format_string('<Order key="%d">', F.col("o_orderkey")), F.coalesce(status, F.lit("")), F.coalesce(note, F.lit("")),
        F.lit("<Lines>"), F.array_join(line, ""), F.lit("</Lines>"), F.array_join(kind, ""), F.lit("</Order>"),
    )
    return nested.select(xml.alias("xml"))


LINES = "(SELECT DISTINCT o_orderkey AS k, o_orderstatus AS s, l_linenumber AS n, l_returnflag AS f, l_linestatus AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@register(f"""
SELECT CAST(o.k AS VARCHAR) AS variant_id, CASE WHEN o.k % 2 = 0 THEN o.s WHEN o.k % 3 = 0 THEN 'N' || o.k END AS variant_name,
       CASE WHEN o.k % 3 = 0 THEN 'orders' END AS bank, CAST(l.n AS VARCHAR) AS assembly, l.t AS ref
FROM (SELECT DISTINCT k, s FROM {LINES}) o LEFT JOIN (SELECT * FROM {LINES} WHERE f = 'A') l ON l.k = o.k""")
def xml_by_rules(spark, sf):
    records = extract_entities(order_elements(spark, sf), ORDER_RULES)
    bank = F.get("databanks", F.lit(0))["name"].alias("bank")
    return records.select("variant_id", "variant_name", bank, F.explode_outer("assembly").alias("a")).select(
        "variant_id", "variant_name", "bank", "a.assembly", "a.ref"
    )


CORRELATED = f"SELECT CAST(k AS VARCHAR) AS variant_id, 'kind ' || f AS phenotype, CAST(n AS VARCHAR) AS number FROM (SELECT DISTINCT k, f, n, t FROM {LINES})"


@register(CORRELATED)
def xml_correlated(spark, sf):
    """Children found by a value of their sibling."""
    records = extract_entities(order_elements(spark, sf), ORDER_RULES)
    kinds = records.select("variant_id", F.inline("phenotypes")).select("variant_id", "phenotype", F.inline("interpretation"))
    return kinds.select("variant_id", "phenotype", F.col("clinical_significance").alias("number"))


@register(CORRELATED)
def xml_descendant_paths(spark, sf):
    """The same with a descendant path, followed by the structure of the data."""
    deep = [tuple(".//Line[@flag='<value>']" if v == "./Lines/Line[@flag='<value>']" else v for v in r) for r in ORDER_RULES]
    records = extract_entities(order_elements(spark, sf), deep)
    kinds = records.select("variant_id", F.inline("phenotypes")).select("variant_id", "phenotype", F.inline("interpretation"))
    return kinds.select("variant_id", "phenotype", F.col("clinical_significance").alias("number"))


AT_ANY_DEPTH = [("variation", "", "./Order", "Orders", "", "", ""), ("variation", "variant_id", "", "Order", "key", "", "")]


@register(f"SELECT DISTINCT CAST(k AS VARCHAR) AS variant_id, CAST(n AS VARCHAR) AS assembly, t AS ref FROM {LINES} WHERE f = 'A'")
def xml_any_depth(spark, sf):
    """No other rule says where the lines stand."""
    rules = [*AT_ANY_DEPTH, ("assembly", "", ".//Line[@flag='A']", "Order", "", "", ""), ("assembly", "assembly", "", "Line", "number", "", ""), ("assembly", "ref", "", "Line", "", "", "")]
    return extract_entities(order_elements(spark, sf), rules).select("variant_id", F.inline("assembly")).select("variant_id", "assembly", "ref")


@register(f"SELECT DISTINCT CAST(k AS VARCHAR) AS variant_id, 'kind ' || f AS phenotype, CASE WHEN k % 3 = 0 THEN 'N' || k END AS note FROM {LINES}")
def xml_parent_steps(spark, sf):
    """Kinds that have a name, and what stands beside the lines."""
    rules = [
        *AT_ANY_DEPTH, ("variation", "variant_name", "./Lines/../Note", "Order", "code", "", ""),
        ("phenotype", "", "./Kind/Name/..", "Order", "", "", ""), ("phenotype", "phenotype", "./Name", "Kind", "", "", ""),
    ]
    records = extract_entities(order_elements(spark, sf), rules)
    return records.select("variant_id", F.inline("phenotypes"), F.col("variant_name").alias("note")).select("variant_id", "phenotype", "note")


@register(f"""
SELECT variant_id, count(*) FILTER (kind = 'line') AS n_lines, count(*) FILTER (kind = 'name') AS n_names FROM (
  SELECT DISTINCT CAST(k AS VARCHAR) AS variant_id, 'line' AS kind, n || f || t AS what FROM {LINES}
  UNION ALL SELECT DISTINCT CAST(k AS VARCHAR), 'name', f FROM {LINES}) GROUP BY variant_id""")
def xml_any_tag(spark, sf):
    """Grandchildren whatever stands between: the lines, and the names of the kinds."""
    rules = [
        *AT_ANY_DEPTH, ("gene", "", "./*/*", "Order", "", "", ""), ("gene", "gene", "", "Line", "number", "", ""),
        ("hgvs", "", "./*/Name", "Order", "", "", ""), ("hgvs", "hgvs", "", "Name", "", "", ""),
    ]
    lines = F.size(F.filter("genes", lambda g: g.isNotNull())).cast("long")
    return extract_entities(order_elements(spark, sf), rules).select("variant_id", lines.alias("n_lines"), F.size("hgvs").cast("long").alias("n_names"))


@register("""
SELECT CAST(first AS VARCHAR) AS variant_id, CAST(o_orderkey AS VARCHAR) AS inner_id
FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders) WHERE o_orderkey <> first""")
def xml_rows_inside_rows(spark, sf):
    """A customer's first order holds the others; files are cut anywhere, inside rows too."""
    keys = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    inner = F.transform(F.slice("keys", 2, F.greatest(F.size("keys") - 1, F.lit(0))), lambda k: F.format_string('<Order key="%d"><Status/></Order>', k))
    xml = F.concat(F.format_string('<Order key="%d">', F.get("keys", F.lit(0))), F.array_join(inner, ""), F.lit("</Order>"))
    path = scratch_path(spark, "xml")
    keys.select(xml).write.option("lineSep", "  ").text(path)
    rules = [*AT_ANY_DEPTH, ("gene", "", ".//Order", "Order", "", "", ""), ("gene", "gene", "", "Order", "key", "", "")]
    records = read_by_rules(spark, path, rules, nested_rows=True)
    return records.select("variant_id", F.explode("genes").alias("inner_id"))
