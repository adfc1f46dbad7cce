"""A filter of 64-bit numbers of bounded size, which lets all of them through and few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter, 32 MB. Beyond about 20 million numbers it lets more others through, and spares less work.
MOST_BITS = 1 << 28
LEAST_BITS = 1 << 16
#: Bits that each number sets, and bits of the filter for each number.
PROBES, BITS_PER_NUMBER = 3, 12


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """For hashes: so the number's own bits will do, taken from several ends."""
    with np.errstate(over="ignore"):
        mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        return [(mixed + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)]


def holds(table: Broadcast, values: np.ndarray) -> np.ndarray:
    """Which of these numbers the filter lets through."""
    bits = np.frombuffer(table.value, np.uint8)
    found = np.ones(len(values), bool)
    for place in _places(values, len(bits) * 8):
        found &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def filter_of(numbers: DataFrame) -> Broadcast:
    """The filter of a written table's one column of hashes.

    Its bits are set in the tasks; the driver gets 64-bit words of them, at most ``MOST_BITS`` / 64.
    """
    spark, (name,) = numbers.sparkSession, numbers.columns
    count = numbers.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_NUMBER * count).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate(_places(values, size))
            bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bits)], names=["at", "bits"]
            )

    found = (
        numbers.select(F.col(name).cast("long"))
        .mapInArrow(words, "at int, bits long")
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )
    table = np.zeros(size // 64, np.int64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return spark.sparkContext.broadcast(table.tobytes())
