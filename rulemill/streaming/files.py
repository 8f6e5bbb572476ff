"""Run a stateless plan over files as they arrive.

Mapping, transformation, union, search, predicates and quality flags are column plans, so the same functions take a
streaming DataFrame. Nesting is batch only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from rulemill.sources.csv import DATA_SEP, text_schema


def stream_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = DATA_SEP) -> DataFrame:
    """A folder of CSV files with one header, as a stream of text columns."""
    reader = spark.readStream.option("header", True).option("sep", sep).option("escape", '"')
    return reader.schema(text_schema(columns)).csv(path)


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def process_available(
    stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Apply a plan to every file that is there now, append to parquet, and stop. Restarts do not repeat files."""
    query = (
        plan(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
