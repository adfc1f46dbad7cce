"""Data dictionaries, DDL types from profiles, and inspection of characters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.functions import types as ft
from lodgeframe.functions.text import is_ascii
from lodgeframe.operators.joins import lookup_last
from lodgeframe.operators.shape import quoted

# The header of a data dictionary.
DICTIONARY_COLUMNS = [
    "Item No.",
    "Filename",
    "Field Name",
    "Data Type",
    "Max Length (if String)",
    "Mandatory (Y/N) for Business Reporting",
    "Example",
    "Description",
]

# Subjects that a dictionary spells differently.
SUBJECT_NAMES = {"TestReservation": "Test Reservation", "Users": "User"}

# What the added columns of a final profile mean.
COLUMN_DEFINITIONS = [
    (
        "data_dict_is_required_for_reporting",
        "from data dictionary, text indication if field is required for reporting",
    ),
    ("is_required_field", "if field exists in data dictionary, then yes else no"),
    (
        "is_required_for_business_reporting",
        "if data dictionary requirement has any yes character, then yes else no",
    ),
]

# The columns of a final profile, in report order.
FINAL_COLUMNS = [
    "field",
    "file_count",
    "source_data_type",
    "target_data_type",
    "target_data_type_with_20_pct_buffer",
    "transform_needed",
    "source_format",
    "row_count",
    "null_count",
    "is_completely_null",
    "character_blank_count",
    "min_value",
    "min_length_of_characters",
    "value_with_min_length_of_characters",
    "max_value",
    "max_length_of_characters",
    "value_with_max_length_of_characters",
    "max_octet_length",
    "value_with_max_octet_length",
    "avg_length_of_characters",
    "value_with_avg_length_of_characters",
    "count_of_distinct_values",
    "count_of_values_with_leading_whitespace",
    "count_of_values_with_ending_whitespace",
    "count_of_values_with_beginning_and_ending_whitespace",
    "data dict data_type",
    "data dict description",
    "data dict char_max_length",
    "data dict is_required_for_reporting",
    "is_required_field",
    "is_required_for_business_reporting",
]

BUFFER = 1.2


def column_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COLUMN_DEFINITIONS, "column_name string, definition string")


def check_header(df: DataFrame, expected: Sequence[str] = DICTIONARY_COLUMNS) -> DataFrame:
    if df.columns != list(expected):
        raise ValueError(f"header is {df.columns}, expected {list(expected)}")
    return df


def process_dictionary(dictionary: DataFrame, overwrite: DataFrame) -> DataFrame:
    """Normalised and overwritten types, varchar lengths and reporting flags."""
    keys = ["Filename", "Field Name"]
    joined = check_header(dictionary).join(
        overwrite.select(*[quoted(k) for k in keys], "data_type_overwrite"), keys, "left"
    )
    normalized = ft.dictionary_type(F.col("`Data Type`"))
    new_type = F.coalesce(F.col("data_type_overwrite"), normalized)
    mandatory = F.col("`Mandatory (Y/N) for Business Reporting`")
    return joined.select(
        *[quoted(c) for c in DICTIONARY_COLUMNS],
        normalized.alias("data_type_normalized"),
        "data_type_overwrite",
        new_type.alias("data_type_new"),
        ft.varchar_length(F.col("`Max Length (if String)`"), new_type).alias("char_max_length"),
        ft.required_for_reporting(mandatory).alias("is_required_for_reporting"),
    )


def dictionary_subject(subject: str) -> str:
    return SUBJECT_NAMES.get(subject, subject)


def subject_entries(dictionary: DataFrame, subject: str) -> DataFrame:
    return dictionary.filter(F.col("Filename") == dictionary_subject(subject))


def final_profile(
    profile: DataFrame, dictionary: DataFrame, targets: DataFrame, subject: str
) -> DataFrame:
    """A merged profile with dictionary attributes and DDL types.

    ``dictionary`` is a processed one; ``targets`` has data_subject, field,
    data_type_new, transform_needed and source_format. Of repeated entries the
    one with the highest item number, or the last in text order, counts.
    """
    found = lookup_last(
        profile,
        subject_entries(dictionary, subject),
        "field",
        "Field Name",
        {
            "Data Type": "data dict data_type",
            "Description": "data dict description",
            "char_max_length": "data dict char_max_length",
            "is_required_for_reporting": "data dict is_required_for_reporting",
        },
        [F.col("`Item No.`")],
    )
    lowered = [
        "data dict data_type",
        "data dict description",
        "data dict is_required_for_reporting",
    ]
    found = found.withColumns({c: F.lower(F.col(quoted(c))) for c in lowered})
    wanted = ["data_type_new", "transform_needed", "source_format"]
    found = lookup_last(
        found,
        targets.filter(F.col("data_subject") == subject),
        "field",
        "field",
        {w: w for w in wanted},
        [F.col(w) for w in wanted],
    )
    source = ft.source_type(F.col("data_type"), F.col("data_type_new"), F.col("transform_needed"))
    lengths = (F.col("max_length_of_characters"), F.col("max_octet_length"))
    target = F.col("data_type_new")
    typed = found.withColumn("source_data_type", source).withColumns(
        {
            "target_data_type": ft.target_type(F.col("source_data_type"), target, *lengths),
            "target_data_type_with_20_pct_buffer": ft.target_type(
                F.col("source_data_type"), target, *lengths, headroom=BUFFER
            ),
            "is_required_field": ft.is_required_field(F.col("`data dict data_type`")),
            "is_required_for_business_reporting": ft.is_required_for_business_reporting(
                F.col("`data dict is_required_for_reporting`")
            ),
        }
    )
    return typed.select(*[quoted(c) for c in FINAL_COLUMNS])


# ---------------------------------------------------------------- characters


def values_of_octet_length(df: DataFrame, column: str, length: int) -> DataFrame:
    """Distinct values of a given length in bytes."""
    return df.select(quoted(column)).filter(F.octet_length(quoted(column)) == length).distinct()


def non_ascii_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_ascii(F.col(quoted(column))))


def character_bytes(df: DataFrame, column: str, only_non_ascii: bool = False) -> DataFrame:
    """One row per character of a text, with its place and its bytes in UTF-8."""
    if only_non_ascii:
        df = non_ascii_values(df, column)
    rest = [quoted(c) for c in df.columns if c != column]
    chars = df.select(*rest, F.posexplode(F.split(F.col(quoted(column)), "")).alias("at", "char"))
    if only_non_ascii:
        chars = chars.filter(F.octet_length("char") > 1)
    return chars.select(
        *rest,
        (F.col("at") + 1).alias("position"),
        "char",
        F.hex(F.encode("char", "UTF-8")).alias("utf8_bytes"),
        F.octet_length("char").alias("byte_length"),
    )
