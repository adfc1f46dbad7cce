"""Type names: source types, DDL types and dictionary types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgeframe.functions.text import parsed_number
from pyspark.sql import types as T

# Dictionary spellings and the type names they stand for.
DICTIONARY_TYPES = {
    "double": "double precision",
    "float": "double precision",
    "int": "integer",
    "string": "varchar",
}

# Warehouse types and the Spark types they are compared as.
COMPARE_TYPES = {
    "integer": "bigint",
    "bigint": "bigint",
    "character varying": "string",
    "date": "string",
    "timestamp without time zone": "string",
    "boolean": "boolean",
    "double precision": "double",
}

# Warehouse spellings and their short names in a specification.
SHORT_TYPES = {
    "character varying": "varchar",
    "timestamp without time zone": "timestamp",
}

# Mandatory marks that are neither Y nor N, and what they mean.
PARTLY_REQUIRED = {
    "Y (only scans that have a reshop)": "yes partial, if scans have a reshop",
    "Y (except for clickbait lines - Null)": "yes partial, if clickbait lines are not null",
}


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small fixed mapping; null when the key is not in it."""
    result = F.lit(None).cast("string")
    for name, value in mapping.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def profile_type(data_type: T.DataType) -> str:
    """Type name used in profiles."""
    if isinstance(data_type, T.IntegralType):
        return "Int64"
    if isinstance(data_type, (T.FractionalType)):
        return "Float64"
    if isinstance(data_type, T.BooleanType):
        return "Boolean"
    if isinstance(data_type, T.StringType):
        return "String"
    return data_type.simpleString()


def warehouse_type(data_type: T.DataType) -> str:
    """Type name as a warehouse catalog spells it."""
    names = {
        T.ByteType: "integer",
        T.ShortType: "integer",
        T.IntegerType: "integer",
        T.LongType: "bigint",
        T.FloatType: "double precision",
        T.DoubleType: "double precision",
        T.BooleanType: "boolean",
        T.DateType: "date",
        T.TimestampType: "timestamp without time zone",
        T.TimestampNTZType: "timestamp without time zone",
    }
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "character varying"
    return names.get(type(data_type), data_type.simpleString())


def compare_type(warehouse_name: str) -> str:
    return COMPARE_TYPES.get(warehouse_name, "string")


def short_type(warehouse_name: Column) -> Column:
    return F.coalesce(lookup(SHORT_TYPES, warehouse_name), warehouse_name)


def dictionary_type(name: Column) -> Column:
    lowered = F.lower(name)
    return F.coalesce(lookup(DICTIONARY_TYPES, lowered), lowered)


def varchar_length(max_length: Column, data_type: Column) -> Column:
    """Length of a varchar column; null for other types and for lengths that are no number."""
    length = parsed_number(max_length.cast("string")).try_cast("bigint")
    return F.when(data_type == "varchar", length)


def required_for_reporting(mark: Column) -> Column:
    """'yes', 'no' or a partial yes, from a dictionary's mandatory mark."""
    return (
        F.when(F.upper(mark) == "Y", F.lit("yes"))
        .when(F.upper(mark) == "N", F.lit("no"))
        .otherwise(lookup(PARTLY_REQUIRED, mark))
    )


def source_type(data_type: Column, target: Column, transform_needed: Column) -> Column:
    """integer, float, date or string; a string is a date if that needs no transform."""
    lowered = F.lower(data_type)
    is_date = (lowered == "string") & (target == "date") & transform_needed.isNull()
    return (
        F.when(F.contains(lowered, F.lit("int")), F.lit("integer"))
        .when(F.contains(lowered, F.lit("float")), F.lit("float"))
        .when(is_date, F.lit("date"))
        .otherwise(F.lit("string"))
    )


def target_type(
    source: Column,
    target: Column,
    max_chars: Column,
    max_octets: Column,
    headroom: float | None = None,
) -> Column:
    """DDL type: the given target, else varchar of the needed length, else the source type.

    ``headroom`` multiplies the length of a varchar, rounded up. A string
    column without any value and without target has no type.
    """
    # greatest() skips a missing octet length
    length = F.greatest(max_chars.cast("double"), max_octets.cast("double"))
    if headroom is not None:
        length = F.ceil(length * F.lit(float(headroom)))
    varchar = F.concat(F.lit("varchar("), length.cast("bigint").cast("string"), F.lit(")"))
    own_target = target.isNotNull() & ((source != "string") | (target != "string"))
    return F.when(own_target, target).when(source == "string", varchar).otherwise(source)


def is_required_field(dictionary_type_name: Column) -> Column:
    return F.when(dictionary_type_name.isNotNull(), F.lit("yes")).otherwise(F.lit("no"))


def is_required_for_business_reporting(mark: Column) -> Column:
    yes = F.coalesce(F.contains(F.lower(mark), F.lit("yes")), F.lit(False))
    return F.when(yes, F.lit("yes")).otherwise(F.lit("no"))
