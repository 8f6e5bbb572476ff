"""Writers: flat CSV, nested JSON lines, numbered runs and their metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rulemill.functions.columns import blank_to_null, column
from rulemill.operators.nesting import NestingSpec, key_order, nest
from rulemill.operators.quality import apply_quality_sets
from rulemill.plans.rules import Rules
from rulemill.sources.csv import DATA_SEP, RUN_COLUMNS, all_text, text_schema
from rulemill.sources.storage import listed_names, shuffles_dropped

# Prefixes of numbered outputs.
JOB, RESULT = "job", "query_result"


def write_csv(df: DataFrame, path: str, sep: str = DATA_SEP, files: int | None = None, mode: str = "overwrite") -> None:
    """Flat CSV with a header, UTF-8, cells as they are. `files` limits the number of part files without a shuffle."""
    out = df.coalesce(files) if files else df
    writer = out.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(
    df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> None:
    """Nested records as JSON lines; NULL fields are written. What the records were shuffled for is removed from disk when they are written."""
    out = df.coalesce(files) if files else df
    with shuffles_dropped(df.sparkSession):
        out.write.mode(mode).option("ignoreNullFields", False).partitionBy(*partition_by).json(path)


def latest_run(spark: SparkSession, base: str, prefix: str) -> int:
    """The highest number among `<prefix>_<n>` entries below `base`; 0 if there is none."""
    stems = [n.split(".")[0] for n in listed_names(spark, base) if n.startswith(prefix + "_")]
    numbers = [int(s[len(prefix) + 1:]) for s in stems if s[len(prefix) + 1:].isdigit()]
    return max(numbers, default=0)


def next_run_path(spark: SparkSession, base: str, prefix: str) -> str:
    return f"{base.rstrip('/')}/{prefix}_{latest_run(spark, base, prefix) + 1}"


def latest_run_path(spark: SparkSession, base: str, prefix: str) -> str:
    number = latest_run(spark, base, prefix)
    if number == 0:
        raise FileNotFoundError(f"no {prefix}_<n> below {base}")
    return f"{base.rstrip('/')}/{prefix}_{number}"


def write_stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table once as Parquet, `<path>.parquet`, and from that as the CSV `path`; returns the stored table.

    Every column is text and blank cells are NULL, as in a CSV source, but a cell may hold anything, line breaks included:
    the Parquet copy is what later steps read. Another writer taking the path first is an error, not an overwrite.
    """
    text = all_text(df)
    with shuffles_dropped(df.sparkSession):
        text.select(*[blank_to_null(column(c)).alias(c) for c in text.columns]).write.mode("errorifexists").parquet(f"{path}.parquet")
    stored = read_stored(df.sparkSession, path)
    write_csv(stored, path, mode="errorifexists")
    return stored


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """A table that `write_stored` wrote."""
    return spark.read.parquet(f"{path}.parquet")


def write_numbered_csv(df: DataFrame, base: str, prefix: str = RESULT) -> str:
    """Store as the next number; the path of the CSV."""
    path = next_run_path(df.sparkSession, base, prefix)
    write_stored(df, path)
    return path


def read_result(spark: SparkSession, base: str, number: int | None = None, prefix: str = RESULT) -> DataFrame:
    """A stored result by number, or the latest. All text, cells as they were stored."""
    path = latest_run_path(spark, base, prefix) if number is None else f"{base.rstrip('/')}/{prefix}_{number}"
    return read_stored(spark, path)


def run_metadata(
    spark: SparkSession,
    sources: Sequence[str],
    kind: str,
    inputs: Sequence[str],
    parameter: str,
    value: str,
    quality_rules: Sequence[str] = (),
) -> DataFrame:
    """The one-row description of a run. Several sources, inputs or rule files are comma-separated in their cell."""
    joined = [", ".join(sources), kind, ", ".join(inputs), parameter, value, ", ".join(quality_rules)]
    return spark.createDataFrame([joined], text_schema(RUN_COLUMNS))


def write_run_metadata(df: DataFrame, run_path: str) -> None:
    write_csv(df, f"{run_path}/search_info.csv", sep=",", files=1)


def with_rules(metadata: DataFrame, quality_rules: Sequence[str]) -> DataFrame:
    """Run metadata carried over to a new result, with its rule files replaced."""
    return metadata.withColumn("quality_rules", F.lit(", ".join(quality_rules)))


def write_quality_sets(
    df: DataFrame, rule_sets: Mapping[str, Rules], spec: NestingSpec, path: str, order_by: str | None = None
) -> None:
    """Flag `df` with every rule set, nest each flagged copy and write it under ruleset=<name>. One copy after the other, so that the disk holds
    the shuffles of one."""
    flagged = apply_quality_sets(df, rule_sets)
    for i, name in enumerate(rule_sets):
        nested = nest(flagged.where(F.col("ruleset") == name), spec, order_by, within=["ruleset"])
        write_json(nested, path, mode="append" if i else "overwrite", partition_by=["ruleset"])


def export_result(
    spark: SparkSession, base: str, out: str, form: str = "csv", spec: NestingSpec | None = None,
    number: int | None = None, order_by: str | None = None,
) -> None:
    """The latest (or a numbered) result as CSV or nested JSON with ascending keys."""
    result = read_result(spark, base, number)
    if form == "csv":
        write_csv(result, out)
    elif form == "json":
        if spec is None:
            raise ValueError("a JSON export needs a nesting specification")
        write_json(key_order(nest(result, spec, order_by), spec.key), out)
    else:
        raise ValueError(f"form must be csv or json, not {form}")


def json_reader_schema(df: DataFrame) -> T.StructType:
    """The schema to read `write_json` output of `df` back with, without inference."""
    return df.schema

