"""Exact search: all queries against all rows, as tiled matrix products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.common import top_rows, written

#: Products of one multiplication take about this many bytes.
PRODUCT_BYTES = 64 << 20


def usable(vector: Column) -> Column:
    """Neither missing nor empty, and no component missing, infinite or not a number."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def scaled(vector: Column, by: int) -> Column:
    """Each component x as floor(by * x), x taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * by))


def _packed(rows: int):
    """Rows (id, vector) of a partition as blocks of one length of vectors and at most ``rows`` rows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[pd.DataFrame]] = {}

        def block(dim: int, parts: list[pd.DataFrame]) -> pd.DataFrame:
            part = pd.concat(parts).sort_values("id", kind="stable")
            matrix = np.stack(part["vector"].to_numpy()).astype("<i8")
            ids = part["id"].to_numpy("<i8")
            return pd.DataFrame(
                {"dim": [dim], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()]}
            )

        for batch in batches:
            for dim, part in batch.groupby(batch["vector"].map(len)):
                waiting.setdefault(dim, []).append(part)
                while (n := sum(map(len, waiting[dim]))) >= rows:
                    whole = pd.concat(waiting[dim])
                    yield block(dim, [whole[:rows]])
                    waiting[dim] = [whole[rows:]] if n > rows else []
        for dim, parts in waiting.items():
            if sum(map(len, parts)):
                yield block(dim, parts)

    return pack


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: through doubles where every partial sum is exact in them."""
    most = lambda m: int(np.abs(m).max(initial=0))
    if most(queries) * most(rows) * rows.shape[1] < 1 << 53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _best_of_tiles(k: int):
    """The ``k`` best rows of each query in each tile."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tile in batch.itertuples(index=False):
                ids = np.frombuffer(tile.ids, "<i8")
                rows = np.frombuffer(tile.matrix, "<i8").reshape(len(ids), -1)
                asking = np.frombuffer(tile.query_ids, "<i8")
                queries = np.frombuffer(tile.query_matrix, "<i8").reshape(len(asking), -1)
                step = max(1, PRODUCT_BYTES // (8 * len(ids)))
                for at in range(0, len(asking), step):
                    found = [
                        (query, one[0], one[1])
                        for query, scores in zip(
                            asking[at : at + step], _product(queries[at : at + step], rows)
                        )
                        if len((one := _select(scores, ids, query, k))[0])
                    ]
                    if found:
                        yield pd.DataFrame(
                            {
                                "branch": tile.branch,
                                "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                                "vec_id": np.concatenate([f[1] for f in found]),
                                "score": np.concatenate([f[2] for f in found]),
                            }
                        )

    return best


def _select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of rows in ascending order of ids, without the query's own; ties to smaller ids."""
    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    if last > first:
        scores, ids = np.delete(scores, slice(first, last)), np.delete(ids, slice(first, last))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        level = np.flatnonzero(scores == least)[: k - len(above)]
        keep = np.concatenate([above, level])
        scores, ids = scores[keep], ids[keep]
    return ids, scores


def exact_top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    tile_rows: int = 16384,
    tile_queries: int = 4096,
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query, found exactly.

    ``rows`` and ``queries`` have ``id`` (long) and ``vector`` (array of long).
    Rows are packed where they lie into blocks of at most ``tile_rows``, queries
    into blocks of ``tile_queries``; each pair of blocks is one matrix product that
    keeps the ``k`` best of a query. Those lists are merged in two levels, about as many in each.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; fewer than
    ``k`` rows where there are fewer candidates. Ties go to the smaller id. A row
    with the query's own id is no candidate. A row that is not usable(), or has no id,
    takes no part; vectors are compared with vectors of their own
    length only. Repeated rows are candidates each; repeated queries are
    answered once. An empty table on either side gives no rows.
    """
    kept = lambda df: df.select("id", "vector").where(
        F.col("id").isNotNull() & usable(F.col("vector"))
    )
    schema = "dim int, ids binary, matrix binary"
    asked = written(kept(queries).distinct(), "queries")
    groups = max(1, math.ceil(asked.count() / tile_queries))
    candidates = kept(rows)
    branches = max(1, math.ceil(candidates.count() / tile_rows))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = (
        candidates.mapInPandas(_packed(tile_rows), schema)
        .withColumn("branch", F.pmod(F.xxhash64("ids"), F.lit(branches)).cast("int"))
        .withColumn("asked_group", number(groups))
    )
    asking = (
        asked.repartition(groups, F.pmod(F.xxhash64("id"), F.lit(groups)))
        .mapInPandas(_packed(tile_queries), schema)
        .select(
            "dim",
            F.col("ids").alias("query_ids"),
            F.col("matrix").alias("query_matrix"),
            F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("asked_group"),
        )
        .withColumn("branch", number(branches))
    )
    # Each block of rows meets each block of queries of its length once; a pair of numbers has about one
    # tile, so tiles spread over as many tasks as there are pairs.
    tiles = blocks.join(asking, ["dim", "branch", "asked_group"])
    best = tiles.select("branch", "ids", "matrix", "query_ids", "query_matrix").mapInPandas(
        _best_of_tiles(k), "branch int, query_id long, vec_id long, score long"
    )
    boughs = max(1, math.isqrt(branches))
    best = best.withColumn("bough", F.pmod("branch", F.lit(boughs)))
    merged = top_rows(best, ["query_id", "bough"], k, "score", "vec_id", "place").drop("place")
    return top_rows(merged, ["query_id"], k, "score", "vec_id", "rank").select(
        "query_id", "rank", "vec_id", "score"
    )
