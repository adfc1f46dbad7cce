"""Variance columns between versions and sources."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.functions.variance import (
    BUCKET_ORDER,
    order_in,
    var_bucket,
    var_pct,
    var_pct_from_to,
)
from lodgeframe.operators.aggregates import distribution
from lodgeframe.operators.shape import quoted


def add_variance_columns(
    df: DataFrame, category: str, version_from: str, version_to: str
) -> DataFrame:
    """Amount and percentage of variance for room nights and revenue; missing measures are 0."""
    measures = [
        f"{m} {v}" for m in ("room nights", f"{category} rev") for v in (version_from, version_to)
    ]
    df = df.withColumns({m: F.coalesce(F.col(quoted(m)), F.lit(0.0)) for m in measures})
    added = {}
    for m in ("room nights", f"{category} rev"):
        base = F.col(quoted(f"{m} {version_from}"))
        amount = F.col(quoted(f"{m} {version_to}")) - base
        added[f"{m} var amt"] = amount
        added[f"{m} var pct"] = var_pct(amount, base)
    return df.withColumns(added)


def pairwise_variance(
    df: DataFrame,
    measures: dict[str, str],
    pairs: Sequence[tuple[str, str]] | None = None,
    joiner: str = " vs. ",
) -> DataFrame:
    """Amount and percentage of variance between measures.

    ``measures`` maps a short name to a column; ``pairs`` lists (to, from) by
    short name, by default every unordered pair.
    """
    added = {}
    for to, base in pairs if pairs is not None else list(combinations(measures, 2)):
        a, b = F.col(quoted(measures[to])), F.col(quoted(measures[base]))
        added[f"{to}{joiner}{base} var amt"] = a - b
        added[f"{to}{joiner}{base} var pct"] = var_pct(a - b, b)
    return df.withColumns(added)


def source_variance_pct(df: DataFrame, measure: str, sources: Sequence[str]) -> DataFrame:
    """Percentage of variance of each source against each source before it."""
    return df.withColumns(
        {
            f"{measure}_var_pct_{to}_vs_{base}": var_pct_from_to(
                F.col(quoted(f"{measure}_{base}")), F.col(quoted(f"{measure}_{to}"))
            )
            for base, to in combinations(sources, 2)
        }
    )


def variance_distribution(df: DataFrame, pct: str) -> DataFrame:
    """Rows per variance bucket in report order, with their share of all rows."""
    name = f"{pct}_distribution"
    counted = distribution(df.select(var_bucket(F.col(quoted(pct))).alias(name)), name)
    return counted.orderBy(order_in(BUCKET_ORDER, F.col(quoted(name))))


def variance_distributions(df: DataFrame, pcts: Sequence[str]) -> DataFrame:
    """The distributions of several percentages, counted in one pass."""
    buckets = F.array(
        *[F.struct(F.lit(p).alias("pct"), var_bucket(F.col(quoted(p))).alias("bucket")) for p in pcts]
    )
    counts = (
        df.select(F.inline(buckets))
        .groupBy("pct", "bucket")
        .agg(F.count(F.lit(1)).alias("distribution_count"))
    )
    total = F.sum("distribution_count").over(Window.partitionBy("pct"))
    return counts.withColumn(
        "distribution_count_%_total", F.col("distribution_count") / total
    ).filter(F.col("bucket").isNotNull())


def one_distribution(distributions: DataFrame, pct: str) -> DataFrame:
    """The distribution of one percentage, in report order."""
    return (
        distributions.filter(F.col("pct") == pct)
        .orderBy(order_in(BUCKET_ORDER, F.col("bucket")))
        .select(
            F.col("bucket").alias(f"{pct}_distribution"),
            "distribution_count",
            quoted("distribution_count_%_total"),
        )
    )
