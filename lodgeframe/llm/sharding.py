"""Shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lodgeframe.llm.common import numbered, written

#: Fixed value: the multiplier of the published generator.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: jump from shard count to shard count until past the end.

    The generator is seeded by the key, so the jumps below ``shards`` do not depend
    on it: with one more shard a key either stays or moves to the new one.
    """
    state = keys.astype(np.uint64)
    at, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            at[moving] = ahead[moving]
            state[moving] = state[moving] * STEP + np.uint64(1)
            drawn = (state[moving] >> np.uint64(33)).astype(np.float64) + 1
            ahead[moving] = ((at[moving] + 1) * (2.0**31 / drawn)).astype(np.int64)
            moving = moving[ahead[moving] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a key of any type; a missing key is a key like others."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf(IntegerType())
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy().view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def shard_documents(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Place documents in shards and number them there.

    Columns: ``doc_id``, ``size`` (UTF-8 bytes of the text plus 1, for a missing
    text 1), ``text_crc32`` (missing text: as empty), ``shard``, ``slot``
    (gapless from 0 in each shard, in the order of keys) and ``grown_shard``, the place with one
    more shard. Rows are neither dropped nor merged: repeated keys share a shard
    and get a slot each; a missing key is placed like any other. An empty
    table gives no rows. Other columns are ignored, whatever their names.

    Only fixed-width rows are shuffled, once by range and once by partition
    number, so neither a hot key nor a full shard has to fit in one task.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
    )
    # a missing key must still meet itself in the joins of numbered()
    return numbered(written(placed, "shards"), ["shard"], ["doc_id", "text_crc32"], "slot")
