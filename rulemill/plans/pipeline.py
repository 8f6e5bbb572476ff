"""Whole jobs: integrate sources, extract a variant release, query a stored result, re-check a stored run.

Each job is one lazy plan from the scans to the sinks; nothing is staged in between.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from rulemill.operators.explore import drop_all_null
from rulemill.operators.integrate import found_nothing, search, unite
from rulemill.operators.mapping import clean_cells, map_columns
from rulemill.operators.nesting import NestingSpec, flatten, nest
from rulemill.operators.transform import apply_transforms, transform_problems
from rulemill.plans.predicates import query
from rulemill.plans.rules import RuleError, Rules
from rulemill.sources import sinks
from rulemill.sources.csv import read_csv
from rulemill.sources.storage import delete_folder
from rulemill.sources.xml import read_elements
from rulemill.variants.clinvar import extract_variants, of_phenotype
from rulemill.variants.derive import derive_attributes, with_assembly_dates
from rulemill.variants.schema import VARIANT_COLUMNS, VARIANT_SPEC


@dataclass(frozen=True)
class Source:
    """A flat table with the rules that bring it to the target schema. `mapping` is None for mapped tables.

    Text cells are trimmed and blank ones are NULL after mapping and again after the transformations, as between files.
    Turn `clean` off for columnar sources whose cells are clean: predicates on untransformed columns then reach the scan.
    """

    frame: DataFrame
    mapping: Rules | None = None
    transforms: Rules = field(default_factory=list)
    name: str = ""
    clean: bool = True


def prepare(source: Source) -> DataFrame:
    mapped = source.frame if source.mapping is None else map_columns(source.frame, source.mapping)
    if not source.clean:
        return apply_transforms(mapped, source.transforms)
    return clean_cells(apply_transforms(clean_cells(mapped), source.transforms))


def source_problems(sources: Sequence[Source]) -> list[tuple[str, int, str, str]]:
    """(source, rule_no, attribute, message) of the transformation rules of every source."""
    found = []
    for s in sources:
        mapped = s.frame if s.mapping is None else map_columns(s.frame, s.mapping)
        found += [(s.name, *p) for p in transform_problems(mapped, s.transforms)]
    return found


def integrate(
    sources: Sequence[Source],
    schema: Sequence[str] = VARIANT_COLUMNS,
    parameter: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """Map and transform every source, unite them on the schema, and search if a parameter is given."""
    united = unite([prepare(s) for s in sources], schema)
    return united if parameter is None else search(united, parameter, value)


def variants_of_release(
    spark: SparkSession,
    paths: str | Sequence[str],
    phenotype: str | None = None,
    row_tag: str = "VariationArchive",
    version: Column | None = None,
    assemblies: DataFrame | None = None,
    clean_first: bool = True,
) -> DataFrame:
    """The flat, derived variant table of release files, of one phenotype if given."""
    records = extract_variants(read_elements(spark, paths, row_tag), version)
    if phenotype is not None:
        records = of_phenotype(records, phenotype)
    flat = flatten(records, VARIANT_SPEC)
    if assemblies is not None:
        flat = with_assembly_dates(flat, assemblies)
    return derive_attributes(flat, clean_first)


def store_run(
    treated: DataFrame,
    base: str,
    stamp: str,
    metadata: DataFrame,
    rule_sets: Mapping[str, Rules] | None = None,
    spec: NestingSpec = VARIANT_SPEC,
    order_by: str | None = None,
) -> str:
    """Write a run as the next job: the flat table as Parquet and CSV, nested JSON, one nested JSON per rule set, and its metadata.

    An empty result stores nothing and is an error. Every output is computed from the stored flat table, so the
    sources are read once.
    """
    spark = treated.sparkSession
    job = sinks.next_run_path(spark, base, sinks.JOB)
    stored = sinks.write_stored(treated, f"{job}/treated_file.csv")
    if found_nothing(stored):
        delete_folder(spark, job)
        raise RuleError([(0, None, "nothing matches")])
    sinks.write_json(nest(stored, spec, order_by), f"{job}/treated_file.json")
    return store_quality(stored, job, stamp, metadata, rule_sets or {}, spec, order_by)


def store_quality(
    stored: DataFrame,
    job: str,
    stamp: str,
    metadata: DataFrame,
    rule_sets: Mapping[str, Rules],
    spec: NestingSpec = VARIANT_SPEC,
    order_by: str | None = None,
) -> str:
    """Apply rule sets to the stored table of a job and write a new result folder below it."""
    result = f"{job}/result/{stamp}"
    if rule_sets:
        sinks.write_quality_sets(stored, rule_sets, spec, f"{result}/quality.json", order_by)
    sinks.write_run_metadata(sinks.with_rules(metadata, list(rule_sets)), result)
    return result


def recheck_run(
    spark: SparkSession, job: str, from_stamp: str, stamp: str, rule_sets: Mapping[str, Rules],
    spec: NestingSpec = VARIANT_SPEC,
) -> str:
    """Re-apply quality rules to a stored run; its metadata is carried over."""
    stored = sinks.read_stored(spark, f"{job}/treated_file.csv")
    metadata = read_csv(spark, f"{job}/result/{from_stamp}/search_info.csv", sep=",")
    return store_quality(stored, job, stamp, metadata, rule_sets, spec)


def run_query(
    df: DataFrame, rules: Rules, base: str, columns: Sequence[str] | None = None
) -> tuple[str, DataFrame]:
    """Query a table, store the result under the next number, and return it read back without empty columns."""
    path = sinks.write_numbered_csv(query(df, rules, columns), base)
    return path, drop_all_null(sinks.read_stored(df.sparkSession, path))
