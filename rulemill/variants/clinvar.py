"""Nested variant records out of ClinVar-style XML, as expressions on the parsed element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulemill.functions.arrays import group_items
from rulemill.functions.columns import blank_to_null, let, null_if_empty, null_string
from rulemill.operators.merging import merge_items_ci
from rulemill.sources.xml import children, parse_elements, read_elements

# The elements and attributes that are read. Repeatable elements are arrays, all leaves text.
CLINVAR_SCHEMA = """
_VariationID string, _Accession string, _VariationName string, _VariationType string,
InterpretedRecord struct<
  SimpleAllele: array<struct<
    Location: array<struct<
      CytogeneticLocation: array<string>,
      SequenceLocation: array<struct<_Assembly: string, _Chr: string, _start: string, _display_start: string,
        _stop: string, _display_stop: string, _referenceAlleleVCF: string, _alternateAlleleVCF: string>>>>,
    HGVSlist: array<struct<HGVS: array<struct<
      NucleotideExpression: array<struct<_Assembly: string, Expression: array<string>>>,
      ProteinExpression: array<struct<Expression: array<string>>>>>>>,
    CanonicalSPDI: array<string>,
    GeneList: array<struct<Gene: array<struct<_Symbol: string,
      Location: array<struct<SequenceLocation: array<struct<_Chr: string>>>>>>>>>>,
  ClinicalAssertionList: array<struct<ClinicalAssertion: array<struct<
    _ID: string,
    ReviewStatus: array<string>,
    Interpretation: array<struct<_DateLastEvaluated: string, Description: array<string>>>,
    ClinVarAccession: array<struct<_SubmitterName: string>>,
    ObservedInList: array<struct<ObservedIn: array<struct<
      Method: array<struct<MethodType: array<string>>>, Sample: array<struct<Origin: array<string>>>>>>>,
    AttributeSet: array<struct<Attribute: array<struct<_Type: string, _VALUE: string>>>>,
    TraitSet: array<struct<Trait: array<struct<Name: array<struct<ElementValue: array<string>>>>>>>>>>>,
  TraitMappingList: array<struct<TraitMapping: array<struct<
    _ClinicalAssertionID: string, MedGen: array<struct<_Name: string>>>>>>>
"""

# The databank record of this source.
DATABANK_NAME, DATABANK_URL = "ClinVar", "https://www.ncbi.nlm.nih.gov/clinvar/"

GENOMIC = "NC_"


def path(elements: Column, *names: str) -> Column:
    """All descendants along a path of child names, in document order."""
    for name in names:
        elements = children(elements, name)
    return elements


def first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def first_text(elements: Column, *names: str) -> Column:
    return blank_to_null(first(path(elements, *names)))


def _allele(element: Column) -> Column:
    return element["InterpretedRecord"]["SimpleAllele"]


def genomic_expressions(element: Column) -> Column:
    """Nucleotide expressions on a genomic reference: array<struct<assembly, expression>>."""
    listed = path(_allele(element), "HGVSlist", "HGVS", "NucleotideExpression")
    pairs = F.transform(
        listed, lambda n: F.struct(n["_Assembly"].alias("assembly"), first(n["Expression"]).alias("expression"))
    )
    return F.filter(pairs, lambda p: p["expression"].startswith(GENOMIC))


def assemblies(element: Column) -> Column:
    """Sequence locations; genomic expressions if there are none. Alleles fall back to the canonical SPDI."""
    located = F.transform(
        path(_allele(element), "Location", "SequenceLocation"),
        lambda s: F.struct(
            s["_Assembly"].alias("assembly"),
            null_string().alias("date"),
            F.coalesce(s["_start"], s["_display_start"]).alias("start"),
            F.coalesce(s["_stop"], s["_display_stop"]).alias("end"),
            s["_referenceAlleleVCF"].alias("ref"),
            s["_alternateAlleleVCF"].alias("alt"),
            s["_alternateAlleleVCF"].alias("risk_allele"),
        ),
    )
    expressed = F.transform(
        genomic_expressions(element),
        lambda e: F.struct(
            e["assembly"].alias("assembly"),
            null_string().alias("date"),
            e["expression"].alias("start"),
            e["expression"].alias("end"),
            null_string().alias("ref"),
            null_string().alias("alt"),
            null_string().alias("risk_allele"),
        ),
    )
    canonical = first_text(_allele(element), "CanonicalSPDI")

    def with_alleles(a: Column) -> Column:
        missing = a["ref"].isNull() & a["alt"].isNull()
        return F.struct(
            *[a[n].alias(n) for n in ("assembly", "date", "start", "end")],
            F.when(missing, canonical).otherwise(a["ref"]).alias("ref"),
            F.when(missing, canonical).otherwise(a["alt"]).alias("alt"),
            F.when(missing, F.coalesce(canonical, a["risk_allele"])).otherwise(a["risk_allele"]).alias("risk_allele"),
        )

    return null_if_empty(F.transform(F.coalesce(null_if_empty(located), expressed), with_alleles))


def chromosome(element: Column) -> Column:
    """First that is present: sequence location, cytogenetic band, genomic name, genomic expression, gene location."""
    allele = _allele(element)
    gene_locations = path(allele, "GeneList", "Gene", "Location", "SequenceLocation")
    name = element["_VariationName"]
    return F.coalesce(
        first(path(allele, "Location", "SequenceLocation"))["_Chr"],
        first_text(allele, "Location", "CytogeneticLocation"),
        F.when(name.startswith(GENOMIC), name),
        F.try_element_at(genomic_expressions(element), F.lit(-1))["expression"],
        first(gene_locations)["_Chr"],
    )


def genes(element: Column) -> Column:
    return null_if_empty(F.transform(path(_allele(element), "GeneList", "Gene"), lambda g: g["_Symbol"]))


def hgvs(element: Column) -> Column:
    """All expressions of the HGVS list, nucleotide before protein within one entry; NULL if there are none."""
    listed = path(_allele(element), "HGVSlist", "HGVS")
    expressions = F.transform(
        listed,
        lambda h: F.concat(
            *[
                F.coalesce(path(h[n], "Expression"), F.array().cast("array<string>"))
                for n in ("NucleotideExpression", "ProteinExpression")
            ]
        ),
    )
    return null_if_empty(F.flatten(expressions))


def databanks(element: Column, version: Column) -> Column:
    return F.array(
        F.struct(
            F.lit(DATABANK_NAME).alias("name"),
            F.lit(DATABANK_URL).alias("url"),
            version.cast("string").alias("version"),
            element["_VariationID"].alias("variant_id"),
            element["_Accession"].alias("clinvar_accession"),
        )
    )


def assertion_method(assertion: Column) -> Column:
    """Text of the last attribute of type AssertionMethod."""
    attributes = path(assertion["AttributeSet"], "Attribute")
    return F.try_element_at(F.filter(attributes, lambda a: a["_Type"] == "AssertionMethod"), F.lit(-1))["_VALUE"]


def interpretation(assertion: Column) -> Column:
    observed = path(assertion["ObservedInList"], "ObservedIn")
    return F.struct(
        first_text(assertion["Interpretation"], "Description").alias("clinical_significance"),
        first_text(observed, "Method", "MethodType").alias("method"),
        assertion_method(assertion).alias("assertion_criteria"),
        first_text(assertion["ReviewStatus"]).alias("level_certainty"),
        first(assertion["Interpretation"])["_DateLastEvaluated"].alias("date"),
        first(assertion["ClinVarAccession"])["_SubmitterName"].alias("author"),
        first_text(observed, "Sample", "Origin").alias("origin"),
    )


def named_assertions(element: Column) -> Column:
    """array<struct<pos, item, names>>: every assertion in its order, with the names mapped to it or else those it states itself.

    Mappings and assertions are put in one list that is grouped by assertion id, so that no assertion looks through all mappings.
    """
    assertions = path(element["InterpretedRecord"]["ClinicalAssertionList"], "ClinicalAssertion")
    mappings = path(element["InterpretedRecord"]["TraitMappingList"], "TraitMapping")
    none = F.get(assertions, F.lit(-1))  # a NULL of the assertions' type
    tagged = F.concat(
        F.coalesce(
            F.transform(mappings, lambda m: F.struct(m["_ClinicalAssertionID"].alias("id"), F.lit(-1).alias("pos"), none.alias("item"), first(m["MedGen"])["_Name"].alias("name"))),
            F.array(),
        ),
        F.transform(
            assertions,
            # an assertion without an id is a group of its own
            lambda a, i: F.struct(F.coalesce(a["_ID"], F.concat(F.lit("\x00"), i.cast("string"))).alias("id"), i.alias("pos"), a.alias("item"), null_string().alias("name")),
        ),
    )

    def members(group: Column) -> Column:
        mapped = F.transform(F.filter(group["items"], lambda t: t["pos"] < 0), lambda t: t["name"])

        def with_names(t: Column) -> Column:
            stated = F.transform(t["item"]["TraitSet"], lambda s: first_text(s["Trait"], "Name", "ElementValue"))
            return F.struct(t["pos"].alias("pos"), t["item"].alias("item"), F.coalesce(null_if_empty(mapped), stated).alias("names"))

        return F.transform(F.filter(group["items"], lambda t: t["pos"] >= 0), with_names)

    grouped = group_items(tagged, lambda t: t["id"])
    return F.array_sort(F.flatten(F.transform(grouped, members)), lambda x, y: x["pos"] - y["pos"])


def phenotypes(element: Column) -> Column:
    """One entry per phenotype name, ignoring case, with the interpretations of all its assertions."""
    none = F.array().cast("array<struct<phenotype:string,interpretation:struct<clinical_significance:string,"
                           "method:string,assertion_criteria:string,level_certainty:string,date:string,"
                           "author:string,origin:string>>>")  # fmt: skip
    found = F.flatten(
        F.transform(
            named_assertions(element),
            lambda a: F.coalesce(
                let(interpretation(a["item"]), lambda i: F.transform(a["names"], lambda n: F.struct(n.alias("phenotype"), i.alias("interpretation")))),
                none,
            ),
        )
    )
    bibliography = "array<struct<title:string,year:string,authors:string,pmid:string,is_gwas:string>>"
    return F.transform(
        merge_items_ci(found, "phenotype"),
        lambda g: F.struct(
            g["phenotype"].alias("phenotype"),
            null_string().alias("clinical_actionability"),
            null_string().alias("classification"),
            F.transform(g["items"], lambda i: i["interpretation"]).alias("interpretation"),
            F.lit(None).cast(bibliography).alias("bibliography"),
        ),
    )


def extract_variants(elements: DataFrame, version: Column | None = None) -> DataFrame:
    """Nested variant records from (xml, ...) rows. variant_name and variant_id are NULL until derived."""
    e = F.col("element")
    absent = ("variant_name", "variant_id", "description", "polyphen_prediction", "sift_prediction")
    return parse_elements(elements, CLINVAR_SCHEMA).select(
        *[null_string().alias(n) for n in absent],
        chromosome(e).alias("chromosome"),
        e["_VariationType"].alias("variant_type"),
        genes(e).alias("genes"),
        hgvs(e).alias("hgvs"),
        assemblies(e).alias("assembly"),
        databanks(e, version if version is not None else null_string()).alias("databanks"),
        phenotypes(e).alias("phenotypes"),
    )


def of_phenotype(variants: DataFrame, phenotype: str) -> DataFrame:
    """Records that list a phenotype, ignoring case."""
    wanted = phenotype.strip().lower()
    return variants.where(F.exists("phenotypes", lambda p: F.lower(p["phenotype"]) == wanted))


def read_variants(
    spark: SparkSession, paths: str | Sequence[str], row_tag: str = "VariationArchive", version: Column | None = None
) -> DataFrame:
    """Nested variant records of release files."""
    return extract_variants(read_elements(spark, paths, row_tag), version)
