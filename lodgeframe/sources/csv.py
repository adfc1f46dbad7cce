"""CSV files: scanning, type inference and writing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.functions.text import parsed_number
from lodgeframe.operators.shape import quoted
from lodgeframe.sources import records

# An unquoted empty field is missing, a quoted one is a blank. Spark keeps the
# two apart when its marker for missing values is one that no file contains.
NO_VALUE = "\u0001NULL"

# How files are read unless a caller says otherwise. Line breaks may stand inside quoted fields, a doubled quote
# is a quote, and a file whose header differs from the others' is an error, not a mix-up.
DIALECT = {
    "header": True,
    "encoding": "UTF-8",
    "nullValue": NO_VALUE,
    "escape": '"',
    "multiLine": True,
    "enforceSchema": False,
}

TYPES = {"Int64": "bigint", "Float64": "double", "Boolean": "boolean", "String": "string"}


def scan_csv(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = True
) -> DataFrame:
    """All columns as text, exactly as in the files, which must have one header.

    Large files are split, although line breaks may stand inside quoted fields: see ``sources.records``, which reads
    them twice. Lines end with a line feed, with or without a carriage return before it. A quoted field that is never closed is an error. ``multi_line=False``
    reads them once, and is only for files known to have no such line breaks.
    """
    if multi_line:
        return records.parsed(records.read_lines(spark, path), DIALECT, one_header=True).drop("file_name")
    return spark.read.options(**{**DIALECT, "multiLine": False}).csv(path)


def infer_types(df: DataFrame, overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Narrowest type that every value of each text column fits, from one pass.

    Int64, Float64, Boolean or String. Dates stay text. A column without values
    is text, as is one with an override of "String".
    """
    overrides = dict(overrides or {})
    open_columns = [c for c in df.columns if c not in overrides]
    counts = []
    for i, c in enumerate(open_columns):
        v = F.col(quoted(c))
        counts += [
            F.count(v).alias(f"n{i}"),
            F.count(_whole_number(v)).alias(f"int{i}"),
            F.count(_number(v)).alias(f"float{i}"),
            F.count_if(v.isin("true", "false")).alias(f"bool{i}"),
        ]
    found = df.agg(*counts).first() if counts else None
    result = {}
    for c in df.columns:
        if c in overrides:
            result[c] = overrides[c]
            continue
        i = open_columns.index(c)
        n = found[f"n{i}"]
        fits = [
            ("Int64", found[f"int{i}"]),
            ("Float64", found[f"float{i}"]),
            ("Boolean", found[f"bool{i}"]),
        ]
        result[c] = next((t for t, k in fits if n > 0 and k == n), "String")
    return result


def _whole_number(v):
    return F.when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast("bigint"))


def _number(v):
    return F.when(~v.rlike(r"\s"), parsed_number(v))


def apply_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast text columns to their inferred types."""
    return df.select(*[F.col(quoted(c)).cast(TYPES[types[c]]).alias(c) for c in df.columns])


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    overrides: Mapping[str, str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV file with inferred types, some of them overridden."""
    text = scan_csv(spark, path, multi_line)
    return apply_types(text, infer_types(text, overrides))


def read_extract(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A comparison extract, whose columns are known; they are found by their names in the header.

    A column that is not there is an error, a value that does not fit its type is missing, and further columns
    are ignored.
    """
    fields = spark.createDataFrame([], schema).schema.fields
    text = scan_csv(spark, path)
    return text.select(*[F.col(quoted(f.name)).try_cast(f.dataType).alias(f.name) for f in fields])


def write_csv(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Overwrite a folder of CSV files with a header; blanks stay blanks."""
    writer = df.write.mode("overwrite").options(
        header=True,
        nullValue="",
        emptyValue='""',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    writer.partitionBy(*partition_by).csv(path)
