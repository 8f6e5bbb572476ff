"""The 36-attribute variant table and its nested form."""

from __future__ import annotations

from rulemill.operators.nesting import Group, NestingSpec, Structs, Values

# The attributes of the integrated table, in order.
VARIANT_COLUMNS = (
    "variant_name", "variant_id", "chromosome", "gene", "variant_type", "description", "polyphen_prediction",
    "sift_prediction", "hgvs", "assembly", "assembly_date", "start", "end", "ref", "alt", "risk_allele", "phenotype",
    "clinical_actionability", "classification", "clinical_significance", "method", "assertion_criteria",
    "level_certainty", "date", "author", "origin", "title", "year", "authors", "pmid", "is_gwas", "name", "url",
    "version", "databanks_variant_id", "clinvar_accession",
)

# Attributes a builder predicate does not treat as text.
VARIANT_TYPES = {"start": "integer", "end": "integer", "year": "integer", "pmid": "integer", "is_gwas": "boolean"}


def _same(*names: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, n) for n in names)


INTERPRETATION = Structs(
    "interpretation",
    _same("clinical_significance", "method", "assertion_criteria", "level_certainty", "date", "author", "origin"),
)
BIBLIOGRAPHY = Structs("bibliography", _same("title", "year", "authors", "pmid", "is_gwas"))

VARIANT_SPEC = NestingSpec(
    key="variant_id",
    scalars=_same(
        "variant_name", "chromosome", "variant_type", "description", "polyphen_prediction", "sift_prediction"
    ),
    values=(Values("genes", "gene"), Values("hgvs", "hgvs")),
    structs=(
        Structs(
            "assembly",
            (("assembly", "assembly"), ("date", "assembly_date"), *_same("start", "end", "ref", "alt", "risk_allele")),
            lead="assembly",
        ),
        Structs(
            "databanks",
            (*_same("name", "url", "version"), ("variant_id", "databanks_variant_id"), *_same("clinvar_accession")),
            lead="name",
        ),
    ),
    groups=(
        Group(
            "phenotypes",
            lead=("phenotype", "phenotype"),
            scalars=_same("clinical_actionability", "classification"),
            structs=(INTERPRETATION, BIBLIOGRAPHY),
        ),
    ),
    order=VARIANT_COLUMNS,
)
