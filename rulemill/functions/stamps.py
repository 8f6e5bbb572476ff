"""Run stamps and names carried in file paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: how a run folder writes the moment it was made.
STAMP_FORMAT = "dd_MM_yyyy HH_mm_ss"
# Fixed value: the zone run stamps are written in.
STAMP_ZONE = "Portugal"


def format_stamp(utc: Column, zone: str = STAMP_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(utc, zone), STAMP_FORMAT)


def parse_stamp(stamp: Column) -> Column:
    """The local time in a run stamp; NULL if the text is no stamp."""
    return F.try_to_timestamp(stamp, F.lit(STAMP_FORMAT))


def stamp_date(stamp: Column) -> Column:
    """`31_12_2022 10_11_12` -> `31/12/2022`."""
    return F.translate(F.substring_index(stamp, " ", 1), "_", "/")


def stamp_time(stamp: Column) -> Column:
    """`31_12_2022 10_11_12` -> `10:11:12`."""
    return F.translate(F.substring_index(stamp, " ", -1), "_", ":")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def plain_path(path: Column, encoded: bool = False) -> Column:
    """A file path without the scheme of local files. Scans give paths percent-encoded, listings as they are."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(decoded, "^file:/+", "/")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def trailing_number(name: Column) -> Column:
    """`query_result_10.csv` -> 10; NULL for a name without a number."""
    return F.regexp_extract(name, r"_([0-9]+)(?:\.[A-Za-z]+)?$", 1).try_cast("bigint")


def result_name(rule_name: Column) -> Column:
    """The stored result that belongs to a rule file: the word `rule` becomes `result`."""
    return F.replace(rule_name, F.lit("rule"), F.lit("result"))
