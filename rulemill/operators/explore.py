"""Look at a result: drop empty columns, search every cell, page, number the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rulemill.functions.columns import any_of, column, let
from rulemill.operators.ranges import numbered, selected

# Page sizes a result can be shown in; None shows all rows.
PAGE_SIZES = (5, 10, 15, 20, 50, None)



def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns that are NULL in every row. One aggregate over the data decides, in an action."""
    filled = df.agg(*[F.bool_or(column(c).isNotNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[column(c) for c, keep in zip(df.columns, filled) if keep])


def keyword_search(df: DataFrame, keyword: str) -> DataFrame:
    """Rows where any cell contains `keyword`, ignoring case."""
    needle = keyword.lower()
    return df.where(any_of(F.lower(column(c).cast("string")).contains(needle) for c in df.columns))


#: Characters by which keywords are found in a text before they are compared.
KEYWORD_CHARACTERS = 3
#: Keywords are found in the words of a cell by as many of their first characters as the largest of these that they have.
CELL_CHARACTERS = (1, 2, 3, 4, 6)
#: Keywords that are looked for in one pass over the cells, for they travel to all tasks.
BLOCK_KEYWORDS = 200_000
#: Words of a cell lie between these.
_BLANKS = r"[\x20\x09-\x0D]+"


def keyword_hits(df: DataFrame, keywords: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, keyword: str = "keyword") -> DataFrame:
    """(keys, column, keyword) for every keyword of a table and every cell that contains it, ignoring case.

    A keyword without blanks lies within a word, so it is looked for once in every distinct word of all cells. Those that are in any go to all tasks, in blocks
    that a job counts, and meet the cells where these are read: neither words of cells nor hits are shuffled. Keywords with blanks, if an action finds
    any, are looked for in the texts. The plan does not depend on the number of keywords but for its blocks. Blank keywords and NULL cells are in no hit; equal keywords are one.
    """
    listed = keywords.select(column(keyword).alias("keyword")).where("keyword <> ''").distinct().withColumn("_needle", F.lower("keyword"))
    names = [c for c in df.columns if c not in keys] if columns is None else list(columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lower(column(c).cast("string")).alias("_text")) for c in names])
    own = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(*[column(k).alias(n) for k, n in zip(keys, own)], F.inline(cells)).where("_text <> ''")
    shown = [*[F.col(n).alias(k) for k, n in zip(keys, own)], "column", "keyword"]

    # distinct within the cell, which need not be searched twice for a word
    words_of = lambda text: F.filter(F.array_distinct(F.split(text, _BLANKS)), lambda w: w != "")
    blank = F.col("_needle").rlike(_BLANKS)
    vocabulary = rows.select(F.explode(words_of("_text")).alias("_text")).distinct()
    single = listed.where(~blank)
    known = _containing(vocabulary, single).select("keyword", "_needle").distinct()
    cells = rows.withColumn("_text", F.array_join(words_of("_text"), " "))
    blocks = max(1, -(-single.count() // BLOCK_KEYWORDS))
    place = F.pmod(F.xxhash64("keyword"), F.lit(blocks))
    hits = reduce(DataFrame.unionByName, [_hits_in_place(cells, known if blocks == 1 else known.where(place == b)) for b in range(blocks)]).select(*shown)
    several = listed.where(blank)
    return hits if several.isEmpty() else hits.unionByName(_containing(rows, several).select(*shown))


def _containing(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of `texts` with every listed keyword that is in their `_text`. The distinct runs of up to three characters of a text are joined with the
    first characters of the keywords, and what meets is compared."""
    needles = listed.withColumn("_run", F.substring("_needle", 1, KEYWORD_CHARACTERS))

    def runs(characters: Column) -> Column:
        several = [
            F.transform(F.slice(F.sequence(F.lit(0), F.size(characters) - 1), 1, F.greatest(F.size(characters) - (length - 1), F.lit(0))), _run_of(characters, length))
            for length in range(1, KEYWORD_CHARACTERS + 1)
        ]
        return F.array_distinct(F.concat(*several))

    placed = texts.withColumn("_run", F.explode(let(F.filter(F.split("_text", ""), lambda c: c != ""), runs)))
    return placed.join(needles, "_run").where(F.contains(F.col("_text"), F.col("_needle")))


def _hits_in_place(cells: DataFrame, listed: DataFrame) -> DataFrame:
    """The cells, as words in `_text` between single blanks, with every listed keyword that is in a word. A cell has each of its runs of some lengths once, and a keyword
    one that it begins with, so a cell meets a keyword once at most. One step from the scan to the hits, in which a text is not copied for its runs."""
    first = F.when(F.lit(False), 0)
    for n in reversed(CELL_CHARACTERS):
        first = first.when(F.length("_needle") >= n, n)
    needles = listed.withColumn("_run", F.substr("_needle", F.lit(1), first))
    runs = F.array_distinct(F.concat(*[F.regexp_extract_all("_text", F.lit(f"(?=([^ ]{{{n}}}))"), F.lit(1)) for n in CELL_CHARACTERS]))
    met = cells.withColumn("_run", F.explode(runs)).join(F.broadcast(needles), "_run")
    return met.where((F.col("_run") == F.col("_needle")) | F.contains(F.col("_text"), F.col("_needle")))


def _run_of(characters: Column, length: int) -> Callable[[Column], Column]:
    return lambda i: F.concat(*[F.get(characters, i + k) for k in range(length)])


def row_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """A unique, increasing, gappy id per row."""
    return df.withColumn(name, F.monotonically_increasing_id())


def ordinals(df: DataFrame, order_by: Sequence[Column | str], name: str = "ordinal", ranges: int | None = None) -> DataFrame:
    """Dense row numbers 1..n over an explicit order, without moving all rows to one task.

    `ranges` (by default the session's number of shuffle partitions, or more where they would hold over a million rows each) are numbered by themselves. Jobs sample and count the order key when this
    is called; the numbering itself is lazy, one shuffle, and stores nothing. Rows that the order leaves equal are ordered by a hash of the row.
    """
    return numbered(df, order_by, name, ranges)


def page(df: DataFrame, order_by: Sequence[Column | str], number: int = 1, size: int | None = 10) -> DataFrame:
    """Page `number` (from 1) of `size` rows; all rows if `size` is None.

    Counting passes find the narrow range of the order in which the page lies, wherever that is; only that range is sorted. Pages do not overlap:
    rows that the order leaves equal are ordered by a hash of the row.
    """
    if size is None:
        return df.orderBy(*order_by)
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return selected(df, order_by, (number - 1) * size, size)


def page_info(df: DataFrame, number: int, size: int | None) -> DataFrame:
    """One row (first_row, last_row, total_rows): "showing a to b of N"."""
    total = F.count(F.lit(1))
    if size is None:
        return df.agg(F.least(total, F.lit(1)).alias("first_row"), total.alias("last_row"), total.alias("total_rows"))
    start = (number - 1) * size + 1
    return df.agg(
        F.when(total >= start, F.lit(start)).otherwise(F.lit(0)).cast("bigint").alias("first_row"),
        F.when(total >= start, F.least(total, F.lit(number * size))).otherwise(F.lit(0)).cast("bigint").alias("last_row"),
        total.alias("total_rows"),
    )
