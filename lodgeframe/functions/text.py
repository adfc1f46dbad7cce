"""Character-level tests on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = [
    *map(chr, range(0x09, 0x0E)),
    "\u0020",
    "\u0085",
    "\u00a0",
    "\u1680",
    *map(chr, range(0x2000, 0x200B)),
    "\u2028",
    "\u2029",
    "\u202f",
    "\u205f",
    "\u3000",
]


def starts_with_whitespace(text: Column) -> Column:
    return F.substring(text, 1, 1).isin(WHITESPACE)


def ends_with_whitespace(text: Column) -> Column:
    return F.substring(text, -1, 1).isin(WHITESPACE)


def is_ascii(text: Column) -> Column:
    """One byte per character means that every character is ASCII."""
    return F.octet_length(text) == F.length(text)


# Numbers as text; a cast alone also takes forms with a type suffix, such as 12D.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"


def parsed_number(text: Column) -> Column:
    """Double, null where the text is no number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_number(value: Column, places: int | None = None) -> Column:
    """Double, null where the text is no number; optionally rounded."""
    number = parsed_number(value.cast("string"))
    number = F.when(F.isnan(number), F.lit(None).cast("double")).otherwise(number)
    return number if places is None else F.round(number, places)


def plain_decimal(value: Column, places: int = 10) -> Column:
    """Number as text without exponent or trailing zeros; '0' for zero."""
    digits = value.cast(f"decimal(38,{places})").cast("string")
    trimmed = F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))
    return F.when(value == 0, F.lit("0")).otherwise(trimmed)
