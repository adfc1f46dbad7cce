"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.common import written
from lodgeframe.sources import scratch


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes of links ``a``, ``b``.

    Alternates large-star and small-star steps: each moves links towards the
    least neighbour, until every link ends at a root. A step is two joins by key
    on tables no larger than the links, written to the shared folder and deleted after the next one. Links
    with a missing end are ignored; loops and repeats do no harm.
    """
    edges = links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = written(edges.distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, before = written(large.distinct(), "large-star"), edges
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(
            small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star"
        )
        scratch.drop(before)
        scratch.drop(large)
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())
