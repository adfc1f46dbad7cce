"""Unions, name overlap, transposition, report order and row numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgeframe.functions.variance import order_in
from lodgeframe.operators.shape import quoted
from lodgeframe.sources.scratch import written


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_diagonal(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with different columns; what a table lacks is missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def column_overlap(a: DataFrame, b: DataFrame, name: str = "column_name") -> DataFrame:
    """Names in both relations, only in the first, or only in the second."""
    sides = a.select(name, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        b.select(name, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    side = F.when(F.max("a") + F.max("b") == 2, "match").when(F.max("a") == 1, "test only")
    return sides.groupBy(name).agg(side.otherwise("prod only").alias("found_in"))


def sort_custom(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Sort by the place of a label in a list, labels outside it last."""
    return df.orderBy(order_in(order, F.col(quoted(column))))


def transpose_metrics(df: DataFrame, metric: str) -> DataFrame:
    """One row per metric and a column per field, to one row per field and metric."""
    fields = [c for c in df.columns if c != metric]
    return df.unpivot(metric, fields, "field", "value")


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = "row_num",
    small_groups: bool = False,
) -> DataFrame:
    """Number rows from 1 in a declared order, within each group or over the whole table.

    With ``small_groups`` each group is numbered by one task, in one shuffle at most: for groups that are known to be small, such as the lines of an order.

    Otherwise no group has to fit in one task. Rows are range-partitioned by group and
    order, so that a large group spreads over many partitions, and numbered
    inside each partition; a row's number is its place there plus the number of
    rows its group has in earlier partitions. Remaining columns, then a random
    number, break ties. The placed rows are written to the shared folder before
    they are counted, so both steps see the same ranges.
    """
    rest = [c for c in df.columns if c not in order_by and c not in partition_by]
    sort = [quoted(c) for c in [*partition_by, *order_by, *rest]]
    if small_groups and partition_by:
        order = Window.partitionBy(*map(quoted, partition_by)).orderBy(*sort[len(partition_by) :])
        return df.withColumn(name, F.row_number().over(order).cast("bigint"))
    placed = (
        df.withColumn("tie", F.rand(7))
        .repartitionByRange(*[F.col(c) for c in sort], F.col("tie"))
        .sortWithinPartitions(*sort, "tie")
        .drop("tie")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33))
    )
    placed = written(placed, "numbered")
    groups = [quoted(c) for c in partition_by]
    # one row per partition and group: small beside the rows, and small per group
    pieces = placed.groupBy("part", *groups).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at")
    )
    earlier = Window.partitionBy(*groups).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = pieces.select(
        F.col("part").alias("start part"),
        *[F.col(quoted(g)).alias(f"start {g}") for g in partition_by],
        "first_at",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
    )
    same = [F.col("part") == F.col("`start part`")] + [
        F.col(quoted(g)).eqNullSafe(F.col(quoted(f"start {g}"))) for g in partition_by
    ]
    numbered = placed.join(starts, reduce(lambda a, b: a & b, same))
    return numbered.select(
        *[quoted(c) for c in df.columns],
        (F.col("before") + F.col("at") - F.col("first_at") + 1).alias(name),
    )


def first_of_length(
    df: DataFrame, by: Sequence[str], column: str, length: Column, name: str
) -> DataFrame:
    """Per group the smallest of the values with the least ``length``, null for a group without values.

    The least lengths come first, hashed as numbers and written (one narrow row a group, so Spark knows their size when it
    joins them); only values of that length are compared at all. Each task passes on one of them per group.
    """
    sized = df.select(
        *[quoted(c) for c in by],
        F.col(quoted(column)).alias("its value"),
        F.when(F.col(quoted(column)).isNotNull(), length).alias("its length"),
    )
    groups = [quoted(c) for c in by]
    least = written(sized.groupBy(*groups).agg(F.min("its length").alias("least length")), "lengths")
    least = least.select(*[F.col(quoted(c)).alias(f"of {c}") for c in by], "least length")
    same = [F.col("`its length`").eqNullSafe(F.col("`least length`"))] + [
        F.col(quoted(c)).eqNullSafe(F.col(quoted(f"of {c}"))) for c in by
    ]
    first = Window.partitionBy(*groups).orderBy("its value")
    return (
        sized.join(least, reduce(lambda a, b: a & b, same))
        .select(*groups, "its value")
        .withColumn("its place", F.row_number().over(first))
        .where(F.col("its place") == 1)
        .select(*groups, F.col("its value").alias(name))
    )
