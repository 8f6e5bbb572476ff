"""CSV records whose quoted cells hold line breaks, read by many tasks.

A file is read line by line in byte ranges. Whether a line break ends a record depends on the number of quotes before it, and
that is a sum: every range counts its lines with an odd number of quotes, prefix sums over the ranges of a file tell where a
range starts inside a cell, and from there the lines are put together. Lines in front of a range that belong to a record of an
earlier one go to the range where it began.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

QUOTE = '"'


def _odd_quotes(line: Column, sep: str) -> Column:
    """Whether a line turns the inside of a quoted cell to the outside or back.

    A quoted cell doubles its own quotes, so quotes between two other characters never open or close one; an unquoted cell may hold
    some, as in 5"x. They are left out before counting.
    """
    plain = rf"[^{QUOTE}{re.escape(sep)}\r]"
    edges = F.when(line.contains(QUOTE), F.regexp_replace(line, f"(?<={plain}){QUOTE}+(?={plain})", "")).otherwise(F.lit(""))
    return F.length(F.replace(edges, F.lit(QUOTE), F.lit(""))) % 2 != F.length(edges) % 2


def record_lines(lines: DataFrame, sep: str) -> DataFrame:
    """(path, start, row, value) lines -> (path, first, record, value): whole records, numbered in the range `first` where they begin.

    `start` is the byte range of a line and `row` grows within it. One row per range is broadcast; the text is shuffled once, by range.
    """
    marked = lines.withColumn("odd", _odd_quotes(F.col("value"), sep))
    ranges = marked.groupBy("path", "start").agg(F.count_if("odd").alias("turns"), F.min(F.when(F.col("odd"), F.col("row"))).alias("first_turn"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2 == 1
    opened_in = F.last(F.when(F.col("turns") > 0, F.col("start")), ignorenulls=True).over(earlier)
    ranges = ranges.select("path", "start", "first_turn", F.when(inside, opened_in).alias("opened_in"))

    # up to the line that closes it, what a range finds open belongs to the range where that began
    continued = F.col("opened_in").isNotNull() & F.coalesce(F.col("row") <= F.col("first_turn"), F.lit(True))
    placed = marked.join(F.broadcast(ranges), ["path", "start"]).withColumn("first", F.when(continued, F.col("opened_in")).otherwise(F.col("start")))
    order = Window.partitionBy("path", "first").orderBy("start", "row")
    turned = F.coalesce(F.sum(F.col("odd").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("begins", turned % 2 == 0)
    numbered = numbered.withColumn("record", F.sum(F.col("begins").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the lines of a record are where the window has put them: no second exchange
    parts = F.sort_array(F.collect_list(F.struct("start", "row", "value")))
    whole = numbered.groupBy("path", "first", "record").agg(parts.alias("parts"))
    return whole.select("path", "first", "record", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))


def read_records(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], sep: str, encoding: str = "UTF-8", check_header: bool = True) -> DataFrame:
    """The cells of CSV files with a header, as text. Cells may hold line breaks, separators and doubled quotes; a quote at the edge of an
    unquoted cell is not allowed. Empty records are left out, short ones filled with NULL. `encoding` must write ASCII as single bytes.
    """
    value = F.col("value")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        value = F.decode(value.cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        value.alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    records = record_lines(lines, sep).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    names = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"sep": sep, "escape": QUOTE, "multiLine": "true"}
    is_header = (F.col("first") == 0) & (F.col("record") == 1)
    parsed = records.where("value <> ''").select(is_header.alias("is_header"), "path", F.from_csv("value", names, options).alias("cells"))
    header = F.lit(False)
    if check_header:
        found = F.array_join(F.array(*[F.col("cells").getField(c) for c in columns]), sep, "")
        wanted = sep.join(columns)
        told = F.concat(F.lit(f"the header of a CSV file is not {wanted}: "), F.col("path"))
        header = F.when(F.regexp_replace(found, "^\ufeff", "") != wanted, F.raise_error(told).cast("boolean")).otherwise(F.lit(False))
    return parsed.where(F.when(F.col("is_header"), header).otherwise(F.lit(True))).select("cells.*")
