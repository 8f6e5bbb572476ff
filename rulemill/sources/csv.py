"""CSV sources: every column text, blank cells NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rulemill.functions.columns import column
from rulemill.plans.rules import Rule, read_rules
from rulemill.sources.records import read_records

DATA_SEP = ";"
METADATA_SEP = ","


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = DATA_SEP,
    columns: Sequence[str] | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """A CSV with a header. With `columns` no job is run to read the header, and headers are checked against it.

    Files are split across tasks. `multi_line` accepts line breaks inside quoted cells, at the cost of a second pass that counts
    quotes and of one shuffle (see `records`); only encodings that do not write ASCII as single bytes are read by one task per file.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    reader = (
        spark.read.option("header", True).option("sep", sep).option("escape", '"').option("encoding", encoding)
        .option("multiLine", multi_line)
    )
    if multi_line and not encoding.upper().startswith(("UTF-16", "UTF16", "UTF-32", "UTF32")):
        return read_records(spark, files, columns or reader.csv(files).columns, sep, encoding, check_header=columns is not None)
    if columns is not None:
        reader = reader.schema(text_schema(columns)).option("enforceSchema", False)
    return reader.csv(files)


def with_source_path(df: DataFrame, name: str = "path") -> DataFrame:
    """The file every row came from."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def with_file_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Where every row of a file scan stands: path, offset of its split, and place in it. Unique per row, in the order of the files' names.

    Spark packs files by size, so the order in which rows are read says nothing across files; this does. Pass it as `order_by`.
    """
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(name, place)


def read_run_metadata(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All run-metadata files in one read, with the path each row came from."""
    return with_source_path(read_csv(spark, paths, sep=METADATA_SEP, columns=RUN_COLUMNS))


# The columns of a run-metadata file.
RUN_COLUMNS = ("sources", "type", "filenames/phenotype", "parameter", "value", "quality_rules")


def rule_column(rules: list[Rule], name: str) -> list[str | None]:
    """One column of a rule table, in rule order."""
    return [r[name] for r in rules]


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, what a CSV source would give. Nested columns become JSON."""

    def text(f: T.StructField) -> Column:
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        return (F.to_json(column(f.name)) if nested else column(f.name).cast("string")).alias(f.name)

    return df.select(*[text(f) for f in df.schema])


__all__ = [
    "DATA_SEP", "METADATA_SEP", "RUN_COLUMNS", "all_text", "read_csv", "read_rules", "read_run_metadata",
    "rule_column", "text_schema", "with_file_position", "with_source_path",
]
