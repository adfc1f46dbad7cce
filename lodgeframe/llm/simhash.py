"""Near-duplicates by SimHash fingerprints, joined in the space of their segments' bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodgeframe.llm.common import written
from lodgeframe.llm.components import components

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Rows of a cell beyond which it is compared in tiles of two parts each.
TILE = 2048
#: Longest run of a cell that is compared by shifting the whole batch.
SHORT = 8


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half of the shingles' hashes."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(tokens))
    total = len(tokens) - width + 1
    spans = zip(starts[:total].tolist(), ends[width - 1 :].tolist())
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(joined[a:b], 42) for a, b in spans), np.uint64, total)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` of every row, over its whole text."""

    @F.pandas_udf(LongType())
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.select(F.col(key).alias("doc_id"), of_texts(F.col(text)).alias("fp"))


def bit_counts(fps: np.ndarray, width: int) -> np.ndarray:
    """The number of set bits of each ``width``-bit segment: the embedding, one row per fingerprint."""
    bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), 64 // width, width).sum(axis=2, dtype=np.int16)


def _cells(width: int, distance: int):
    """Every grid cell of a fingerprint.

    The segments are dealt into twice ``distance`` groups. Two embeddings within
    ``distance`` in Manhattan distance differ in at most that many groups, so they agree on
    all the others: a cell is a choice of half of the groups with their counts.
    """
    groups = np.array_split(np.arange(64 // width), 2 * distance)
    choices = [np.concatenate(c) for c in combinations(groups, distance)]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            counts = bit_counts(fps, width).astype(np.int64)
            keys = []
            for number, chosen in enumerate(choices):
                key = np.zeros(len(fps), np.int64)
                for segment in chosen:
                    key = key * (width + 1) + counts[:, segment]
                keys.append(key * len(choices) + number)
            yield pd.DataFrame({"cell": np.concatenate(keys), "fp": np.tile(fps, len(choices))})

    return emit


def _near(a: np.ndarray, b: np.ndarray, width: int, distance: int) -> np.ndarray:
    """Which pairs of rows are linked: the Manhattan bound first, then the exact distance."""
    possible = np.flatnonzero(
        np.abs(bit_counts(a, width) - bit_counts(b, width)).sum(axis=1) <= distance
    )
    exact = np.bitwise_count((a[possible] ^ b[possible]).view(np.uint64)) <= distance
    return possible[exact]


def _forest(fps: np.ndarray, width: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is joined among these fingerprints, fewer than there are fingerprints."""
    counts = bit_counts(fps, width)
    left = np.arange(len(fps))  # not reached yet
    came, went = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            bound = np.abs(counts[left] - counts[at]).sum(axis=1) <= distance
            near = bound & (np.bitwise_count((fps[left] ^ fps[at]).view(np.uint64)) <= distance)
            new = left[near]
            came.append(np.full(len(new), at))
            went.append(new)
            front.extend(new.tolist())
            left = left[~near]
    none = np.zeros(0, np.int64)
    return fps[np.concatenate([none, *came])], fps[np.concatenate([none, *went])]


def _links(width: int, distance: int):
    """Links within each cell and tile of a partition sorted by them."""

    def of_runs(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64)
        same = rows["cell"].to_numpy(), rows["tile"].to_numpy()
        starts = np.flatnonzero(
            np.r_[True, (same[0][1:] != same[0][:-1]) | (same[1][1:] != same[1][:-1])]
        )
        sizes = np.diff(np.r_[starts, len(fps)])
        run = np.repeat(np.arange(len(starts)), sizes)
        short = np.repeat(sizes <= SHORT, sizes)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for shift in range(1, min(SHORT, int(sizes.max(initial=0)))):
            pairs = np.flatnonzero((run[shift:] == run[:-shift]) & short[shift:])
            near = _near(fps[pairs], fps[pairs + shift], width, distance)
            a.append(fps[pairs[near]])
            b.append(fps[pairs[near] + shift])
        for at in np.flatnonzero(sizes > SHORT):
            one, other = _forest(fps[starts[at] : starts[at] + sizes[at]], width, distance)
            a.append(one)
            b.append(other)
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the last run may go on in the next batch; a run is at most two parts of a cell
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            if not len(rows):
                continue
            last = rows.iloc[-1]
            end = (rows["cell"] == last["cell"]) & (rows["tile"] == last["tile"])
            yield of_runs(rows[~end])
            kept = rows[end].reset_index(drop=True)
        if kept is not None:
            yield of_runs(kept)

    return emit


def links(fps: DataFrame, distance: int = 3, width: int = 2) -> DataFrame:
    """``a``, ``b``: links that connect distinct fingerprints ``fp`` as all links together do.

    Fingerprints are joined on grid cells of their segments' bit counts. A cell of over
    ``TILE`` fingerprints is dealt into parts, and each two parts meet in a tile
    of their own, so no task holds a large cell and no pair is missed. Each
    cell or tile gives fewer links than it has rows (up to 28 for eight rows), never all its pairs.
    """
    if not 1 <= distance <= 16 or width not in (1, 2, 4):
        raise ValueError("distance must be 1 to 16 and width 1, 2 or 4")
    cells = fps.select("fp").mapInPandas(_cells(width, distance), "cell long, fp long")
    crowded = (
        cells.groupBy("cell")
        .count()
        .where(F.col("count") > TILE)
        .select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    dealt = cells.join(crowded, "cell", "left").select(
        "cell", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).alias("part")
    )
    tiles = dealt.select(
        "cell",
        "fp",
        "part",
        "parts",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
    ).select(
        "cell",
        "fp",
        (F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
        .cast("long")
        .alias("tile"),
    )
    return (
        tiles.repartition("cell", "tile")
        .sortWithinPartitions("cell", "tile")
        .select("cell", "tile", "fp")
        .mapInPandas(_links(width, distance), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 3,
    distance: int = 3,
    width: int = 2,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` of every row.

    Texts are lower-cased (A-Z only), split at ASCII white space and hashed by
    shingles of ``words`` words, with repeats; a shorter text is one shingle. A missing,
    empty or blank text has fingerprint zero and is linked like any other. Two
    fingerprints are linked at up to ``distance`` differing bits; ``component_id`` is the
    smallest ``doc_id`` that can be reached over links. Rows with a missing
    ``doc_id`` link too, but give no name to a component; where all ids
    are missing it is null. Repeated rows share a component. Other columns are ignored. An empty
    table gives no rows.

    Equal fingerprints become one row before anything is joined, so copies cost nothing.
    """
    marked = written(fingerprints(docs, key, text, words), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = written(components(links(nodes, distance, width)), "components")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
