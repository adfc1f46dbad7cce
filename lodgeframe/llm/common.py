"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodgeframe.sources.scratch import written

__all__ = ["bounded_sample", "held_out", "numbered", "read", "top_rows", "written"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a missing id is held out."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(folds)) == fold, F.lit(True))


def bounded_sample(df: DataFrame, key: str, label: str, size: int, most_labels: int) -> DataFrame:
    """At most ``size`` rows of each label, chosen by a hash of the key.

    Labels are counted first, so that each task passes on only the share of its rows that is wanted; what meets
    per label is about ``size`` rows, however many there are. More than ``most_labels`` labels are an error.
    """
    spark = df.sparkSession
    counts = df.groupBy(label).count().limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    # rather too many, for the hashes of a label's keys are only about evenly spread
    shares = [(r[label], min(1.0, (1.2 * size + 50) / r["count"])) for r in counts]
    kind = df.schema[label].dataType.simpleString()
    wanted = spark.createDataFrame(shares, f"`{label}` {kind}, _share double")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = df.join(F.broadcast(wanted), label).where(place < F.col("_share"))
    first = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    return near.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= size).select(
        *df.columns
    )


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number rows from 0 within each group, in the given order; no group has to fit in a task.

    Rows are range-partitioned by group, order and a random tie-break, so a large group spreads over
    many partitions, also one of equal rows. A row's number is its place in its partition plus what
    earlier partitions hold of its group. The input is evaluated twice (ranges
    are sampled), so it should be narrow and already written. Columns named here
    must not start with ``_n_``.
    """
    placed = written(
        df.withColumn("_n_tie", F.rand(7))
        .repartitionByRange(*group, *order, "_n_tie")
        .sortWithinPartitions(*group, *order, "_n_tie")
        .drop("_n_tie")
        .withColumn("_n_at", F.monotonically_increasing_id())
        .withColumn("_n_part", F.shiftright("_n_at", 33)),
        "numbered",
    )
    pieces = placed.groupBy("_n_part", *group).agg(
        F.count(F.lit(1)).alias("_n_rows"), F.min("_n_at").alias("_n_first")
    )
    earlier = Window.partitionBy(*group).orderBy("_n_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = pieces.select(
        "_n_part",
        *group,
        (F.coalesce(F.sum("_n_rows").over(earlier), F.lit(0)) - F.col("_n_first")).alias("_n_base"),
    )
    return placed.join(starts, ["_n_part", *group]).select(
        *df.columns, (F.col("_n_base") + F.col("_n_at")).alias(name)
    )


def top_rows(df: DataFrame, by: Sequence[str], k: int, score: str, tie: str, name: str) -> DataFrame:
    """The ``k`` rows of highest score of each group, ties to the smaller ``tie``, numbered from 1."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie)))
    return df.withColumn(name, place).where(F.col(name) <= k)
