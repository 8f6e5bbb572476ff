"""XML sources: one row per repeated element, split across tasks.

The text is cut at the closing tag of the row element, so a large file is read by many tasks. The closing tag must not
occur in comments or CDATA. A row element that may contain itself is put together again from its cuts: the depth at a cut is
the sum of the tags before it, so prefix sums over the byte ranges of a file tell how deep each range begins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# Attribute fields carry this prefix in a parsed element, and element text this name.
ATTRIBUTE_PREFIX, TEXT_FIELD = "_", "_VALUE"

_CORRUPT = "_corrupt_record"
_OPTIONS = {"attributePrefix": ATTRIBUTE_PREFIX, "valueTag": TEXT_FIELD}


def _closed_pattern(tag: str) -> str:
    return rf"""<{re.escape(tag)}(?:\s[^>"'/]*+(?:(?:"[^"]*+"|'[^']*+'|/(?!>))[^>"'/]*+)*+)?/>"""


def _open_pattern(tag: str) -> str:
    return rf"""<{re.escape(tag)}(?:\s[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)?>"""


def read_elements(
    spark: SparkSession, paths: str | Sequence[str], row_tag: str, encoding: str = "UTF-8", nested: bool = False
) -> DataFrame:
    """(xml, path): the source text of every `row_tag` element; with `nested`, of every one that is not inside another.

    `encoding` may be any one in which tags are written in plain ASCII bytes, such as ISO-8859-1. `nested` costs a pass that counts
    tags and one shuffle of the text.
    """
    closing = f"</{row_tag}>"
    reader = spark.read.option("lineSep", closing)
    chunks = reader.text(list(paths) if not isinstance(paths, str) else paths)
    text = F.col("value")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        text = F.decode(text.cast("binary"), encoding)
    chunks = chunks.select(
        text.alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    if nested:
        chunks = _outermost(chunks, row_tag)
    # A chunk is what lies between two closing tags: any self-closing elements, then one without its closing tag.
    found = F.regexp_extract_all("value", F.lit(rf"(?s){_closed_pattern(row_tag)}|{_open_pattern(row_tag)}.*"), F.lit(0))
    whole = F.transform(
        found,
        lambda x: F.when(x.rlike(rf"(?s)\A{_closed_pattern(row_tag)}\z"), x).otherwise(F.concat(x, F.lit(closing))),
    )
    return chunks.select(F.explode(whole).alias("xml"), "path")


def occurs(spark: SparkSession, paths: str | Sequence[str], row_tag: str, encoding: str = "UTF-8") -> bool:
    """Whether files have a tag at all, in an action that stops at the first. Cut at the closing tag, a file without it would be one line that
    a task holds whole; here it is cut at every tag."""
    text = F.col("value")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        text = F.decode(text.cast("binary"), encoding)
    pieces = spark.read.option("lineSep", ">").text(list(paths) if not isinstance(paths, str) else paths)
    return not pieces.where(text.rlike(rf"<{re.escape(row_tag)}(?=[\s/]|\z)")).isEmpty()


def _outermost(chunks: DataFrame, row_tag: str) -> DataFrame:
    """(value, path): chunks from one that begins outside all row elements to the one that ends there, joined by the closing tag.

    A chunk opens some elements and closes one. Chunks in front of a range that belong to an element of an earlier range go to the range
    where that began. One row per range is broadcast; the text is shuffled once, by range.
    """
    count = lambda pattern: F.size(F.regexp_extract_all("value", F.lit(pattern), F.lit(0)))
    chunks = chunks.withColumn("net", count(rf"<{re.escape(row_tag)}(?=[\s/>])") - count(_closed_pattern(row_tag)) - 1)
    within = Window.partitionBy("path", "start").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    levels = chunks.select("path", "start", "row", "net").withColumn("level", F.sum("net").over(within))
    firsts = levels.groupBy("path", "start", "level").agg(F.min("row").alias("row"), F.sum("net").alias("net"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = firsts.groupBy("path", "start").agg(F.sum("net").alias("net"), F.map_from_entries(F.collect_list(F.struct("level", "row"))).alias("rows"))
    ranges = ranges.withColumn("depth", F.coalesce(F.sum("net").over(earlier), F.lit(0).cast("long")))
    # the chunk after which a range that begins inside an element is outside
    ranges = ranges.withColumn("closed_at", F.try_element_at("rows", -F.col("depth")))
    begins = F.when((F.col("depth") == 0) | F.col("closed_at").isNotNull(), F.col("start"))
    ranges = ranges.select("path", "start", "closed_at", F.when(F.col("depth") > 0, F.last(begins, ignorenulls=True).over(earlier)).alias("opened_in"))
    continued = F.col("opened_in").isNotNull() & F.coalesce(F.col("row") <= F.col("closed_at"), F.lit(True))
    placed = chunks.join(F.broadcast(ranges), ["path", "start"]).withColumn("first", F.when(continued, F.col("opened_in")).otherwise(F.col("start")))
    order = Window.partitionBy("path", "first").orderBy("start", "row")
    depth = F.coalesce(F.sum("net").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("outside", (depth == 0).cast("long"))
    numbered = numbered.withColumn("element", F.sum("outside").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("path", "first", "element").agg(F.sort_array(F.collect_list(F.struct("start", "row", "value"))).alias("parts"))
    return parts.select(F.array_join(F.transform("parts", lambda p: p["value"]), f"</{row_tag}>").alias("value"), "path")


def _parsed(xml: Column, schema: T.StructType) -> Column:
    """The element as a struct with the field `_corrupt_record`, filled where it is malformed. Comments are no text."""
    plain = F.when(xml.contains("<!--"), F.regexp_replace(xml, r"(?s)<!--.*?-->", "")).otherwise(xml)
    return F.from_xml(plain, T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())]), _OPTIONS)


def parse_elements(elements: DataFrame, schema: T.StructType | str, name: str = "element") -> DataFrame:
    """Add the element parsed into a declared struct. Declare repeatable children as arrays.

    Malformed elements are left out; `malformed_elements` lists them. White space around a text is not part of it.
    The struct comes out of a one-element explode: filters on it are not pushed below, where each would parse again.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = elements.select("*", F.explode(F.array(_parsed(F.col("xml"), declared))).alias(name))
    return parsed.where(F.col(name).getField(_CORRUPT).isNull())


def malformed_elements(elements: DataFrame) -> DataFrame:
    """The (xml, path) rows that are not well-formed XML."""
    parsed = elements.select("*", F.explode(F.array(_parsed(F.col("xml"), T.StructType()))).alias("_element"))
    return parsed.where(F.col("_element").getField(_CORRUPT).isNotNull()).drop("_element")


def read_xml(spark: SparkSession, paths: str | Sequence[str], row_tag: str, schema: T.StructType | str) -> DataFrame:
    """One row per element, its declared fields as columns. No schema inference."""
    parsed = parse_elements(read_elements(spark, paths, row_tag), schema)
    return parsed.select("element.*").drop(_CORRUPT)


def field(parent: Column, name: str) -> Column:
    return parent.getField(name)


def attribute(element: Column, name: str) -> Column:
    return element.getField(ATTRIBUTE_PREFIX + name)


def text_of(element: Column) -> Column:
    return element.getField(TEXT_FIELD)


def children(elements: Column, name: str) -> Column:
    """Child elements `name` of every element of an array, in document order; NULL only if the input is."""
    lists = F.transform(elements, lambda e: e.getField(name))
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))
