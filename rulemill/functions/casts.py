"""Casts that give NULL for malformed text instead of an error, with ANSI mode left on."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, functions as F, types as T

# Rule type name -> Spark SQL type.
SQL_TYPES = {
    "integer": "int",
    "float": "float",
    "double": "double",
    "byte": "tinyint",
    "short": "smallint",
    "long": "bigint",
    "decimal": "decimal(10,0)",
    "string": "string",
    "boolean": "boolean",
}

INTEGRAL_RULE_TYPES = ("integer", "byte", "short", "long")

# Wide enough for any bigint, with 18 fraction digits.
EXACT = "decimal(38,18)"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def is_text(source: T.DataType | None) -> bool:
    return source is None or isinstance(source, (T.StringType, T.CharType, T.VarcharType))


def is_integral(source: T.DataType | None) -> bool:
    return isinstance(source, _INTEGRAL)


def is_fractional(source: T.DataType | None) -> bool:
    return isinstance(source, _FRACTIONAL)


def as_text(c: Column, source: T.DataType | None) -> Column:
    return c if is_text(source) and source is not None else c.cast("string")


def tolerant_cast(c: Column, rule_type: str, source: T.DataType | None = None) -> Column:
    """`c` as a rule type; NULL where it cannot be read as one.

    Text with a fraction is truncated for the integral types ("1.7" -> 1), text in exponent
    notation is not an integer ("1e2" -> NULL).
    """
    sql_type = SQL_TYPES[rule_type]
    if rule_type == "string":
        return as_text(c, source)
    if isinstance(source, (T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        c, source = c.cast("string"), T.StringType()
    if rule_type in INTEGRAL_RULE_TYPES and is_text(source):
        # Spoiling the exponent letter keeps one reference to the column.
        return F.translate(c, "eE", "xx").try_cast(EXACT).try_cast(sql_type)
    return c.try_cast(sql_type)


def comparable(c: Column, rule_type: str, source: T.DataType | None = None) -> Column:
    """`c` in the type a query rule compares in.

    Columns that are already numbers are left alone, so the comparison can be pushed to the scan.
    Text is read exactly (not truncated) for integer and decimal rules.
    """
    if rule_type == "string":
        return as_text(c, source)
    if rule_type == "boolean":
        return c if isinstance(source, T.BooleanType) else as_text(c, source).try_cast("boolean")
    if is_integral(source) or is_fractional(source) or isinstance(source, T.DecimalType):
        return c
    target = EXACT if rule_type in ("integer", "decimal") else "double"
    return as_text(c, source).try_cast(target)


def parse_number(text) -> Decimal | None:
    """The exact value of a rule threshold, or None if it is not a finite number."""
    try:
        value = Decimal(str(text).strip())
    except InvalidOperation:
        return None
    return value if value.is_finite() else None


def number_literal(value: Decimal, source: T.DataType | None = None) -> Column:
    """A literal in the type that compares with `source` without casting the column."""
    if isinstance(source, T.FloatType):
        return F.lit(float(value)).cast("float")
    if is_fractional(source):
        return F.lit(float(value))
    if value == value.to_integral_value() and abs(value) < 2**63:
        return F.lit(int(value))
    return F.lit(value)


def parse_boolean(text) -> bool | None:
    # The spellings Spark reads as booleans.
    spelled = str(text).strip().lower()
    if spelled in ("true", "t", "yes", "y", "1"):
        return True
    if spelled in ("false", "f", "no", "n", "0"):
        return False
    return None
