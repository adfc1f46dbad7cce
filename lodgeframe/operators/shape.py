"""Choosing, renaming, casting and filling columns; filters on tags."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.functions.text import to_number


def quoted(name: str) -> str:
    """A column name as it must be written where dots and blanks have a meaning."""
    return "`" + name.replace("`", "``") + "`"


def select_existing(df: DataFrame, order: Iterable[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    return df.select(*[quoted(c) for c in order if c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def rename_versions(df: DataFrame, category: str, versions: Iterable[str]) -> DataFrame:
    """Measure names of an extract to report names, per version."""
    names = {}
    for v in versions:
        names[f"room_nights {v}"] = f"room nights {v}"
        names[f"chkout_{category}_usd_amt {v}"] = f"{category} rev {v}"
    return rename(df, names)


def suffix_all_but(df: DataFrame, keys: Iterable[str], suffix: str) -> DataFrame:
    keep = set(keys)
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keep})


def rename_upper_source(df: DataFrame, category: str, keep: Iterable[str] = ()) -> DataFrame:
    """``room_rev_abc_v2`` to ``room rev ABC v2``; other underscores to blanks."""
    keep = set(keep)

    def new_name(name: str) -> str:
        if name in keep:
            return name
        words = name.replace("_", " ").split(" ")
        if category in name:
            if len(words) != 4:
                raise ValueError(f"{name!r} is not of the form category_measure_source_version")
            words[2] = words[2].upper()
        return " ".join(words)

    return df.toDF(*[new_name(c) for c in df.columns])


def rename_positional(df: DataFrame, like: DataFrame) -> DataFrame:
    """Give the columns the names of another table's, by position."""
    return df.toDF(*like.columns)


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case names, without the ``.n`` that marks a repeated header. Names that become equal are an error."""
    names = [re.sub(r"\.[0-9]+$", "", c).lower() for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"several columns would be named {repeated}")
    return df.toDF(*names)


def to_numeric(df: DataFrame, places: Mapping[str, int]) -> DataFrame:
    """Cast columns to numbers rounded to the given places; text that is no number is null."""
    return df.withColumns({c: to_number(F.col(quoted(c)), n) for c, n in places.items()})


def all_string(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in df.columns])


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that does not fit its type becomes null and ends nothing."""
    return df.withColumns({c: F.col(quoted(c)).try_cast(t) for c, t in types.items()})


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def tagged(df: DataFrame, tag: str, column: str = "row_source") -> DataFrame:
    return df.filter(F.col(column) == tag)


def all_in(columns: Iterable[str], accepted: Iterable[str]) -> Column:
    """Whether every column holds an accepted value; a missing value does not."""
    accepted = list(accepted)
    tests = [F.coalesce(F.col(quoted(c)).isin(accepted), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
