"""Derived and cleaned variant attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulemill.functions.columns import column
from rulemill.operators.transform import apply_transforms

# Cleaning rules (attribute, function, regular expression, replacement). The patterns for alt and
# risk_allele keep the last base only.
CLEANING_RULES = (
    ("phenotype", "replace", ",", ""),
    ("start", "extract", r"g\.([0-9]+)", None),
    ("end", "extract", r"g\.([0-9]+)", None),
    ("ref", "extract", ":([a-zA-Z]):", None),
    ("alt", "extract", "([a-zA-Z])$", None),
    ("risk_allele", "extract", "([a-zA-Z])$", None),
    ("chromosome", "extract", "(^[^pq]*)", None),
    ("chromosome", "extract", "NC_0+([0-9]+).", None),
)

# Clinical significance -> clinical actionability.
ACTIONABILITY = {
    "Disorder causing or risk factor": (
        "pathogenic", "pathologic", "likely pathogenic", "risk factor", "affects", "association",
    ),
    "Not disorder causing or protective effect": (
        "benign", "likely benign", "association not found", "protective",
    ),
    "Affects drugs or treatment response": ("drug response", "confers sensitivity"),
    "Uncertain role": ("vus", "uncertain significance", "conflicting data from submitters"),
}
NOT_PROVIDED = "Not provided"


def variant_name(
    chromosome: Column, start: Column, end: Column, ref: Column, alt: Column, assembly: Column
) -> Column:
    """`Chr1:g.5-6:A>G(GRCh38)`, or `Chr1:ImpreciseVariant` if start, end, ref or alt is NULL."""
    exact = F.concat(
        F.lit("Chr"), chromosome, F.lit(":g."), start, F.lit("-"), end, F.lit(":"), ref, F.lit(">"), alt,
        F.lit("("), assembly, F.lit(")"),
    )
    known = start.isNotNull() & end.isNotNull() & ref.isNotNull() & alt.isNotNull()
    return F.when(known, exact).otherwise(F.concat(F.lit("Chr"), chromosome, F.lit(":ImpreciseVariant")))


def clinical_actionability(significance: Column) -> Column:
    """The actionability group of a clinical significance, ignoring case."""
    folded, grouped = F.lower(significance), None
    for label, spellings in ACTIONABILITY.items():
        fits = folded.isin(*spellings)
        grouped = F.when(fits, label) if grouped is None else grouped.when(fits, label)
    return grouped.otherwise(NOT_PROVIDED)


def derive_attributes(df: DataFrame, clean_first: bool = True) -> DataFrame:
    """Clean the extracted cells, then compose variant_name, variant_id and clinical_actionability.

    `clean_first=False` composes the name from the cells as they were extracted.
    """

    def compose(frame: DataFrame) -> DataFrame:
        return frame.withColumns(
            {
                "variant_name": variant_name(*[column(c) for c in ("chromosome", "start", "end", "ref", "alt", "assembly")]),
                "variant_id": F.coalesce(column("variant_id"), column("clinvar_accession")),
                "clinical_actionability": clinical_actionability(column("clinical_significance")),
            }
        )

    if clean_first:
        return compose(apply_transforms(df, CLEANING_RULES))
    return apply_transforms(compose(df), CLEANING_RULES)


def with_assembly_dates(df: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Look up assembly_date by assembly in a (assembly, assembly_date) table; NULL where unknown."""
    dated = df.drop("assembly_date").join(assemblies.select("assembly", "assembly_date"), "assembly", "left")
    return dated.select(*[column(c) for c in df.columns])
