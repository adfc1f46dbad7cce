"""Totals, roll-ups, distributions and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.operators.shape import quoted

# Sums of money and nights are taken in decimals, so that their order does not matter.
EXACT = "decimal(28,6)"


def exact_sum(name: str):
    return F.sum(F.col(quoted(name)).cast(EXACT)).cast("double").alias(name)


def totals(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    return df.agg(*[exact_sum(m) for m in measures])


def sum_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*[quoted(k) for k in keys]).agg(*[exact_sum(m) for m in measures])


def sum_by_rest(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Group by every column that is no measure, and sum the measures."""
    return sum_by(df, [c for c in df.columns if c not in measures], measures)


def hierarchy_levels(
    df: DataFrame,
    levels: Mapping[str, Sequence[str]],
    measures: Sequence[str],
    null_dim: str = "drop",
) -> dict[str, DataFrame]:
    """Sums at each level of a hierarchy, each computed from the level below.

    ``levels`` goes from the finest to the coarsest. A missing dimension is
    dropped (``null_dim="drop"``) or filled with any other given label.
    """
    result = {}
    below = df
    for name, keys in levels.items():
        if null_dim == "drop":
            below = below.dropna(subset=list(keys)) if keys else below
        else:
            below = below.withColumns(
                {k: F.coalesce(F.col(quoted(k)).cast("string"), F.lit(null_dim)) for k in keys}
            )
        below = sum_by(below, keys, measures)
        result[name] = below
    return result


def distribution(df: DataFrame, bucket: str) -> DataFrame:
    """Rows per bucket and their share of all rows, rows without a bucket included in the total."""
    counts = df.groupBy(quoted(bucket)).agg(F.count(F.lit(1)).alias("distribution_count"))
    total = counts.agg(F.sum("distribution_count").alias("n")).scalar()
    return counts.filter(F.col(quoted(bucket)).isNotNull()).withColumn(
        "distribution_count_%_total", F.col("distribution_count") / total
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column; a missing value is one of them."""
    return df.select(quoted(column)).distinct()


def distinct_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns]).dropDuplicates()


def variance_counts(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Checked rows and rows with a variance, per key."""
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_count"),
        F.count_if(F.col("is_variance") == "yes").alias("variance_count"),
    )


def variance_matrix(
    cells: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    population: DataFrame | None = None,
) -> DataFrame:
    """Differing cells per key and column, zero where there are none, and their total.

    With a ``population``, each of its keys has a row, also one without any difference. The keys take part
    in the grouping, so there is no join, and missing ones match missing ones.
    """
    counts = [
        F.count_if(F.col("column_name") == c).alias(c) for c in columns
    ]
    named = cells.select(*[quoted(k) for k in keys], "column_name")
    if population is not None:
        every = population.select(*[quoted(k) for k in keys]).distinct()
        named = named.unionByName(every.withColumn("column_name", F.lit(None).cast("string")))
    return (
        named.groupBy(*[quoted(k) for k in keys])
        .agg(*counts)
        .withColumn("Total Variances", sum((F.col(quoted(c)) for c in columns), F.lit(0)))
    )


def variance_detail(cells: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The differing values of one column."""
    return cells.filter(F.col("column_name") == column).select(
        *keys,
        F.col("test_value").alias(f"{column}_test"),
        F.col("prod_value").alias(f"{column}_prod"),
    )


def run_summary(cells: DataFrame, keys: Sequence[str], population: DataFrame | None = None) -> DataFrame:
    """Status and mismatches per key of a positional comparison.

    The status tells keys without any row on a side; the comparison says so in its row of counts. With a ``population``,
    exactly its keys have a row, also one without any cell. They take part in the grouping, as in variance_matrix().
    """
    names = [quoted(k) for k in keys]
    counted = F.col("column_name") == "__ROW_COUNT__"
    empty = {side: counted & (F.col(f"{side}_value") == "0") for side in ("test", "prod")}
    rows = cells.select(
        *names,
        F.coalesce(empty["test"], F.lit(False)).alias("no_test"),
        F.coalesce(empty["prod"], F.lit(False)).alias("no_prod"),
        (F.col("match") == "N").alias("differs"),
        F.lit(False).alias("chosen"),
    )
    if population is not None:
        no = F.lit(None).cast("boolean")
        every = population.select(*names).distinct()
        rows = rows.unionByName(every.select(*names, no.alias("no_test"), no.alias("no_prod"), no.alias("differs"), F.lit(True).alias("chosen")))
    status = (
        F.when(F.bool_or("no_test"), F.lit("missing in test"))
        .when(F.bool_or("no_prod"), F.lit("missing in prod"))
        .when(F.count("no_test") == 0, F.lit("missing in both"))
        .otherwise(F.lit("OK"))
    )
    summary = rows.groupBy(*names).agg(
        status.alias("status"), F.count_if("differs").alias("mismatches"), F.bool_or("chosen").alias("chosen")
    )
    return (summary if population is None else summary.filter("chosen")).drop("chosen")
