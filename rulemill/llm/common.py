"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulemill.functions.columns import column
from rulemill.sources.storage import delete_folder, scratch_path

#: A word is a run of characters other than ASCII white space; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to Python, where the session names none: rows may be long.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a task holds of a partition by bytes, not by Spark's default of 10,000 rows, unless the session says how."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: it cuts lineage, so a lost executor never makes earlier stages run again."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only what text operators read: the id as a long and the text as UTF-8 bytes. Other columns stay behind, whatever their names."""
    bounded_batches(df.sparkSession)
    return df.select(column(id_column).cast("long").alias("doc_id"), column(text_column).cast("string").cast("binary").alias("text"))


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, per_batch: int = 4096) -> DataFrame:
    """Run `rows`, a generator over tuples, on every partition and send back Arrow batches of at most `per_batch` rows.

    One generator lives as long as its partition, so it may keep state from row to row.
    """
    bounded_batches(df.sparkSession)
    types = schema_of(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in rows(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))):
            out.append(row)
            if len(out) >= per_batch:
                yield as_batch(out, types)
                out = []
        if out:
            yield as_batch(out, types)

    return df.mapInArrow(run, schema)


def as_batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)


def schema_of(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def unsigned(hashed: Column) -> Column:
    """The upper 53 bits of a 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11).cast("double") * F.lit(2.0**-53)


class Scratch:
    """Intermediate tables of one operator, deleted together once what reads them is itself written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, label: str) -> DataFrame:
        """Write the last table, delete the others, and return it."""
        out = written(df, label)
        for path in self.paths:
            delete_folder(self.spark, path)
        self.paths = []
        return out
