"""Approximate search: inverted lists scanned by adaptive sampling of rotated dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.common import top_rows, written
from lodgeframe.llm.exact_search import usable

#: Pairs of a query and a row that are looked at together.
PAIRS = 1 << 19
#: Share of pairs below which they are followed one by one.
FEW = 0.05
#: Standard deviations by which a list's nearer rows are nearer than its mean row.
NEARER = 2.5


def searchable(vector: Column) -> Column:
    """usable() and not all zero."""
    return usable(vector) & F.exists(vector, lambda x: x != 0)


@dataclass
class Index:
    """What the driver fits on a bounded sample; every row is then assigned by it."""

    rotation: np.ndarray
    centres: np.ndarray
    radius: float  # largest norm of all rows
    spread: np.ndarray  # mean squared distance of a list's rows to its centre
    probes: int
    sample: np.ndarray  # turned
    sample_ids: np.ndarray

    def turn_rows(self, rows: np.ndarray) -> np.ndarray:
        """Rotated rows with one dimension more, which makes all norms equal: the largest inner
        product is then the least distance."""
        rest = np.maximum(0.0, self.radius**2 - (rows**2).sum(axis=1))
        return np.concatenate([rows, np.sqrt(rest)[:, None]], axis=1) @ self.rotation

    def turn_queries(self, rows: np.ndarray) -> np.ndarray:
        """Queries scaled to the same norm, which changes no order of rows."""
        scaled = rows * (self.radius / np.linalg.norm(rows, axis=1, keepdims=True))
        return np.concatenate([scaled, np.zeros((len(rows), 1))], axis=1) @ self.rotation

    def nearest_lists(self, turned: np.ndarray, count: int) -> np.ndarray:
        """Lists in order of how near their nearer rows should be.

        A row lies at about the centre's squared distance plus its own to the centre, give or take what
        a random direction contributes; a tight list is worth a visit though its centre is farther.
        """
        reach = 2 * NEARER * np.sqrt(self.spread / turned.shape[1]) * self.radius
        return np.argsort(
            _distances(turned, self.centres) + (self.spread - reach)[None, :], axis=1, kind="stable"
        )[:, :count]

    def bound(self, turned: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Squared distance within which the sample has twice ``k`` rows other than the query's own."""
        if len(self.sample) < 2 * k + 1:
            return np.full(len(turned), np.inf)
        far = _distances(turned, self.sample)
        far[ids[:, None] == self.sample_ids[None, :]] = np.inf
        kth = np.partition(far, 2 * k - 1, axis=1)[:, 2 * k - 1]
        return kth * (1 + 1e-9) + 1e-9 * self.radius**2


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, of each row of ``a`` to each of ``b``."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T), 0.0)


def _centres(rows: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = rows[rng.choice(len(rows), count, replace=False)]
    for _ in range(rounds):
        of = _distances(rows, centres).argmin(axis=1)
        sizes = np.bincount(of, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        empty = np.flatnonzero(sizes == 0)
        centres[empty] = rows[rng.choice(len(rows), len(empty), replace=False)]
    return centres


def fit_index(
    vectors: np.ndarray, ids: np.ndarray, total: int, radius: float, k: int, target: float
) -> Index:
    """Rotation, list centres, and as many probes as find a share of ``target`` of the ``k`` nearest in the sample."""
    rng = np.random.default_rng(0)
    dim = vectors.shape[1] + 1
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    count = int(np.clip(round(math.sqrt(total) / 2), 1, max(1, len(vectors) // 32)))
    none = np.zeros((0, dim))
    index = Index(rotation, none, radius, np.zeros(0), count, none, ids)
    index.sample = index.turn_rows(vectors)
    index.centres = _centres(index.sample, count, rng)
    own = _distances(index.sample, index.centres)
    of = own.argmin(axis=1)
    index.spread = np.bincount(of, weights=own.min(axis=1), minlength=count) / np.maximum(
        np.bincount(of, minlength=count), 1
    )
    if total > 2 * k:
        asked = np.arange(min(512, len(vectors)))
        far = _distances(index.turn_queries(vectors[asked]), index.sample)
        far[asked, asked] = np.inf
        near = np.argpartition(far, min(k, len(vectors) - 1) - 1, axis=1)[:, :k]
        order = index.nearest_lists(index.turn_queries(vectors[asked]), count)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(count)[None, :], axis=1)
        reached = np.sort(np.take_along_axis(place, of[near], axis=1).ravel())
        index.probes = int(reached[min(len(reached) - 1, math.ceil(target * len(reached)))]) + 1
    return index


def scan(
    rows: np.ndarray, queries: np.ndarray, bound: np.ndarray, block: int, doubt: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of turned vectors within ``bound``, by columns in blocks of ``block``.

    After d of D columns a pair is given up if its partial distance, scaled by D / d, exceeds the bound by
    a factor of (1 + doubt / sqrt(d)) squared: a rotation has made the partial distance that close
    to its share. The last block decides exactly.
    """
    dim = rows.shape[1]

    def limit(d: int) -> np.ndarray:
        return bound * (d / dim) * (1 + doubt / math.sqrt(d)) ** 2 if d < dim else bound

    # as matrix products while many pairs are left, then pair by pair
    sums, at = np.zeros((len(queries), len(rows))), 0
    while True:
        part = slice(at, min(at + block, dim))
        sums += _distances(queries[:, part], rows[:, part])
        kept = sums <= limit(part.stop)[:, None]
        at = part.stop
        if at == dim or np.count_nonzero(kept) < FEW * kept.size:
            break
        sums[~kept] = np.inf
    asking, found = np.nonzero(kept)
    partial = sums[asking, found]
    for at in range(at, dim, block):
        part = slice(at, min(at + block, dim))
        partial = partial + ((queries[asking, part] - rows[found, part]) ** 2).sum(axis=1)
        keep = partial <= limit(part.stop)[asking]
        asking, found, partial = asking[keep], found[keep], partial[keep]
    return asking, found


def _matrix(column: pa.Array | pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1).astype(np.float64)


def _assigned(index: Index, dtype: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.array(batch.column("vector").to_pylist(), dtype)
            lists = _distances(index.turn_rows(raw.astype(np.float64)), index.centres).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(lists.astype(np.int32)),
                    pa.array(np.arange(done, done + len(raw), dtype=np.int64)),
                    pa.array([r.tobytes() for r in raw], pa.binary()),
                ],
                names=["id", "list", "salt", "vector"],
            )
            done += len(raw)

    return emit


def _asked(index: Index, dtype: str, k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = np.array(part.column("vector").to_pylist(), dtype)
                turned = index.turn_queries(raw.astype(np.float64))
                ids = part.column("id").to_numpy()
                lists = index.nearest_lists(turned, index.probes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([r.tobytes() for r in raw], pa.binary()),
                        pa.array(index.bound(turned, ids, k)),
                        pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32())),
                    ],
                    names=["id", "vector", "bound", "lists"],
                )

    return emit


def _scanned(index: Index, dtype: str, k: int, block: int, doubt: float):
    def of_tile(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )
        if not len(rows) or not len(queries):
            return none
        x, q = _matrix(rows["vector"], dtype), _matrix(queries["vector"], dtype)
        ids, asking = rows["id"].to_numpy(np.int64), queries["id"].to_numpy(np.int64)
        turned, wanted = index.turn_rows(x), index.turn_queries(q)
        bound = queries["bound"].to_numpy(np.float64)
        step = max(1, PAIRS // len(x))
        parts = [none]
        for at in range(0, len(q), step):
            some = slice(at, at + step)
            a, b = scan(turned, wanted[some], bound[some], block, doubt)
            a = a + at
            other = asking[a] != ids[b]
            a, b = a[other], b[other]
            score = np.concatenate(
                [np.zeros(0)]
                + [(q[a[i : i + PAIRS]] * x[b[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(a), PAIRS)]
            )
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            starts = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1] if len(a) else np.zeros(0, int)
            place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
            best = place < k
            parts.append(
                pd.DataFrame({"query_id": asking[a[best]], "vec_id": ids[b[best]], "score": score[best]})
            )
        return pd.concat(parts)

    return of_tile


def approximate_top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    fit_rows: int = 8192,
    target: float = 0.97,
    block: int = 16,
    doubt: float = 2.1,
    list_rows: int = 4096,
    list_queries: int = 2048,
) -> DataFrame:
    """The ``k`` rows of largest inner product found for each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``rows`` and ``queries`` have ``id`` (long) and ``vector`` (array of float or double). Lists and
    the number of probed ones are fitted to a sample of at most ``fit_rows`` rows, chosen by a hash of the
    id; all rows are assigned to a list, and all rows of a query's lists are scanned in blocks of
    ``block`` rotated columns. Long lists are dealt into parts of about ``list_rows`` rows and
    queries into parts of about ``list_queries``; each pair of parts is one group of bounded size.

    ``score`` is the inner product of the original vectors in double precision; ties go to the smaller
    id. A row of the query's own id is no candidate. Vectors that are missing, empty, zero or have a missing or
    non-finite component, and rows without an id, take no part. Repeated rows are candidates each, repeated queries are answered
    once. Vectors of several lengths raise an error. An empty table on either side gives no rows.
    """
    dtype = "<f4" if dict(rows.dtypes)["vector"] == "array<float>" else "<f8"
    kept = lambda df: df.select("id", "vector").where(
        F.col("id").isNotNull() & searchable(F.col("vector"))
    )
    rows, queries = kept(rows), kept(queries).distinct()
    square = F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    facts = rows.agg(
        F.count("*").alias("n"),
        F.max(square).alias("most"),
        F.min(F.size("vector")).alias("least"),
        F.max(F.size("vector")).alias("longest"),
    ).first()
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    if facts["least"] != facts["longest"]:
        raise ValueError("vectors of several lengths")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    index = fit_index(
        np.array([r["vector"] for r in sample], np.float64),
        np.array([r["id"] for r in sample], np.int64),
        facts["n"],
        math.sqrt(facts["most"]),
        k,
        target,
    )
    placed = written(
        rows.mapInArrow(_assigned(index, dtype), "id long, list int, salt long, vector binary"),
        "assigned",
    )
    asked = written(
        queries.mapInArrow(
            _asked(index, dtype, k), "id long, vector binary, bound double, lists array<int>"
        ),
        "asked",
    )
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    parts = F.array(
        *[F.lit(max(1, math.ceil(sizes.get(i, 0) / list_rows))) for i in range(len(index.centres))]
    )
    asked_parts = max(1, math.ceil(asked.count() / list_queries))
    dealt_rows = placed.select(
        "list",
        F.pmod("salt", F.element_at(parts, F.col("list") + 1)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1))).alias("asked_part"),
        "id",
        "vector",
    )
    tile = ["list", "part", "asked_part"]

    def searched(some: DataFrame) -> DataFrame:
        by_list = some.select(
            "id",
            "vector",
            "bound",
            F.pmod(F.xxhash64("id", "vector"), F.lit(asked_parts)).cast("int").alias("asked_part"),
            F.explode("lists").alias("list"),
        )
        dealt_queries = by_list.select(
            "list",
            F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("list") + 1) - 1)).alias("part"),
            "asked_part",
            "id",
            "vector",
            "bound",
        )
        found = (
            dealt_rows.groupBy(*tile)
            .cogroup(dealt_queries.groupBy(*tile))
            .applyInPandas(
                _scanned(index, dtype, k, block, doubt), "query_id long, vec_id long, score double"
            )
        )
        return top_rows(found, ["query_id"], k, "score", "vec_id", "rank").select(
            "query_id", "rank", "vec_id", "score"
        )

    first = written(searched(asked), "found")
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = written(
        asked.join(full, "id", "left_anti").withColumn(
            "lists", F.sequence(F.lit(0), F.lit(len(index.centres) - 1))
        ),
        "short",
    )
    # a query whose lists gave too few rows goes through all lists
    enough = first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return enough.unionByName(searched(short)).select(
        "query_id", "rank", "vec_id", "score"
    )
