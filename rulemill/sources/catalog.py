"""Listings of data sets, rule files and runs, as DataFrames over file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulemill.functions.columns import column
from rulemill.functions.stamps import (
    base_name, folder, parse_stamp, plain_path, result_name, stamp_date, stamp_time, trailing_number,
)
from rulemill.operators.integrate import unite
from rulemill.operators.merging import join_on_folder
from rulemill.sources.csv import read_csv, read_run_metadata
from rulemill.sources.storage import first_lines, listed_names

# Files of a data-set folder that are not data.
RULE_FILES = ("mapping_rules.csv", "transformation_rules.csv", "databaseName.csv")
NAME_FILE = "databaseName.csv"


def list_files(spark: SparkSession, base: str) -> DataFrame:
    """path, name and folder of every file below `base`. File contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path")
    listed = listed.select(plain_path(F.col("path")).alias("path"))
    return listed.select("path", base_name(F.col("path")).alias("name"), folder(F.col("path")).alias("folder"))


def read_folder(spark: SparkSession, base: str, schema: Sequence[str]) -> DataFrame:
    """Every CSV source directly below a folder, each read by its own header, united on the schema."""
    names = sorted(n for n in listed_names(spark, base) if not n.startswith(("_", ".")))
    if not names:
        raise FileNotFoundError(f"no sources below {base}")
    root = base.rstrip("/")
    # sources with the same header are one scan
    by_header: dict[str, list[str]] = {}
    for name, headers in sorted(first_lines(spark, root, names).items()):
        for header in sorted(headers):
            by_header.setdefault(header, []).append(f"{root}/{name}")
    return unite([read_csv(spark, paths) for paths in by_header.values()], schema)


def data_files(files: DataFrame) -> DataFrame:
    """The listed files that hold data: no rule files, nothing from the quality-rule folder."""
    in_rules = base_name(F.col("folder")) == "quality_rules"
    return files.where(~F.col("name").isin(*RULE_FILES) & ~in_rules)


def dataset_catalog(spark: SparkSession, base: str) -> DataFrame:
    """dataset name and data path, joined on the folder both files lie in."""
    names = read_csv(spark, f"{base.rstrip('/')}/*/{NAME_FILE}", sep=",", columns=["databaseName"])
    named = names.select(F.col("databaseName").alias("dataset"), F.col("_metadata.file_path").alias("path"))
    data = data_files(list_files(spark, base)).select("path")
    joined = join_on_folder(named.withColumn("path", plain_path(F.col("path"), encoded=True)), data)
    return joined.select("dataset", "path")


def rule_catalog(spark: SparkSession, folder_path: str) -> DataFrame:
    """name and path of every rule file in a folder."""
    return list_files(spark, folder_path).select("name", "path")


def job_catalog(spark: SparkSession, base: str) -> DataFrame:
    """One row per stored run: job, stamp, date, time, type, parameter, value, quality rules.

    Reads <base>/<job>/result/<stamp>/search_info.csv files in one scan.
    """
    runs = read_run_metadata(spark, f"{base.rstrip('/')}/*/result/*/search_info.csv")
    # A written CSV is a folder of part files.
    return describe_runs(runs.withColumn("path", F.regexp_replace(plain_path(F.col("path"), encoded=True), r"(search_info\.csv)/[^/]+$", "$1")))


def describe_runs(runs: DataFrame) -> DataFrame:
    """Job, date and time out of the path of each run-metadata row."""
    run_folder = folder(F.col("path"))
    stamp = base_name(run_folder)
    return runs.select(
        F.regexp_extract("path", "([^/]+)/result/[^/]+/[^/]+$", 1).alias("job"),
        stamp.alias("stamp"),
        stamp_date(stamp).alias("date"),
        stamp_time(stamp).alias("time"),
        parse_stamp(stamp).alias("finished_at"),
        "sources",
        "type",
        "filenames/phenotype",
        "parameter",
        "value",
        "quality_rules",
        run_folder.alias("path"),
    )


def latest_number(df: DataFrame, name: str = "name") -> DataFrame:
    """The highest number in a column of numbered names, compared as a number; NULL if there is none."""
    return df.agg(F.max(trailing_number(column(name))).alias("latest"))


def latest_row(df: DataFrame, by: Column | str) -> DataFrame:
    """The one row with the highest value of `by`."""
    key = column(by) if isinstance(by, str) else by
    return df.orderBy(key.desc_nulls_last()).limit(1)


def result_for_rule(rule_names: Sequence[str] | Column) -> Column:
    """The stored result name of a query-rule file name."""
    return result_name(rule_names if isinstance(rule_names, Column) else F.lit(rule_names))
