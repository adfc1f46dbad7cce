"""Joins in which a missing key matches a missing key, lookups, and restriction to a population."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.operators.shape import quoted
from lodgeframe.sources.scratch import written


#: How many rows of one table have the key, at most.
ROWS = "rows of the key"

# A sample is cut out of the hashes by so many hexadecimal digits at a time, and by sorting where so many keys are left.
DIGITS = 4
MD5_DIGITS = 32
LAST_BIN = 10_000


def outer_join_on(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_left", "_right"),
) -> DataFrame:
    """Full outer join; missing keys match each other, columns of both sides get a suffix.

    Each side's presence is told by the columns ``in_left`` and ``in_right``.
    """
    shared = {c for c in left.columns if c in right.columns and c not in keys}
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared}).withColumn(
        "in_left", F.lit(True)
    )
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    b = b.withColumnsRenamed({k: f"right {k}" for k in keys}).withColumn("in_right", F.lit(True))
    same = reduce(
        lambda x, y: x & y,
        [a[quoted(k)].eqNullSafe(b[quoted(f"right {k}")]) for k in keys],
    )
    joined = a.join(b, same, "full")
    # a key is the left one unless the row is only on the right
    key_columns = [
        F.coalesce(F.col(quoted(k)), F.col(quoted(f"right {k}"))).alias(k) for k in keys
    ]
    left_rest = [quoted(c) for c in a.columns if c not in keys and c != "in_left"]
    right_rest = [
        quoted(c) for c in b.columns if c not in {f"right {k}" for k in keys} and c != "in_right"
    ]
    flags = [
        F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("in_left", "in_right")
    ]
    return joined.select(*key_columns, *left_rest, *right_rest, *flags)


def stack_by_key(
    frames: Mapping[str, DataFrame], keys: Sequence[str], placed_by: Sequence[str] | None = None
) -> DataFrame:
    """One row for each key of any table: the keys, for each table a struct of its other columns (missing where the
    table lacks the key) and ``ROWS``, the most rows that a table has of the key.

    The tables are stacked and shuffled once, by key, and grouped where they lie. Missing keys are one key. No rows are
    paired: of several rows of a key one is kept and counted for the others, so a key that is none costs no memory.

    ``placed_by`` names some of the keys that few rows share. Rows meet by these alone, without a shuffle where the tables
    lie by them.
    """
    kinds = {}
    for name, df in frames.items():
        rest = [F.col(quoted(c)) for c in df.columns if c not in keys]
        # a table of keys only still has something to be told by
        kinds[name] = F.struct(F.lit(True).alias("its row is here"), *rest)
    schemas = {n: df.select(kinds[n].alias("x")).schema[0].dataType for n, df in frames.items()}
    stacked = reduce(
        DataFrame.unionByName,
        [
            df.select(
                *[F.col(quoted(k)) for k in keys],
                *[(kinds[n] if n == name else F.lit(None).cast(schemas[n])).alias(n) for n in frames],
            )
            for name, df in frames.items()
        ],
    )
    by_key = [F.col(quoted(k)) for k in keys]
    grouped = (
        stacked.repartition(*[F.col(quoted(k)) for k in placed_by or keys])
        .groupBy(*by_key)
        .agg(
            *[F.first(F.col(quoted(n)), ignorenulls=True).alias(n) for n in frames],
            F.greatest(*[F.count(F.col(quoted(n))) for n in frames], F.lit(0)).alias(ROWS),
        )
    )
    return grouped


def only_keys(stacked: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The same without ``ROWS``; a key that a table has twice is an error when it is met."""
    names = F.to_json(F.struct(*[F.col(quoted(k)) for k in keys]), {"ignoreNullFields": "false"})
    error = F.raise_error(F.concat(F.lit(f"{what}: {list(keys)} is no key, repeated is "), names))
    return stacked.filter(F.when(F.col(quoted(ROWS)) > 1, error.cast("boolean")).otherwise(True)).drop(ROWS)


def sides_by_key(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_left", "_right"),
    placed_by: Sequence[str] | None = None,
) -> DataFrame:
    """The columns of outer_join_on(), and ``ROWS``: for tables whose keys are keys, or are checked by it.

    ``placed_by`` as in stack_by_key()."""
    shared = {c for c in left.columns if c in right.columns and c not in keys}
    grouped = stack_by_key({"left side": left, "right side": right}, keys, placed_by)
    columns = [F.col(quoted(k)) for k in keys]
    for side, df, suffix in (("left", left, suffixes[0]), ("right", right, suffixes[1])):
        columns += [
            F.col(f"`{side} side`")[c].alias(c + suffix if c in shared else c) for c in df.columns if c not in keys
        ]
    flags = [F.col(f"`{side} side`").isNotNull().alias(f"in_{side}") for side in ("left", "right")]
    return grouped.select(*columns, *flags, quoted(ROWS))


def outer_join_keys(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_left", "_right"),
    placed_by: Sequence[str] | None = None,
) -> DataFrame:
    """outer_join_on() of tables whose keys are keys, in one shuffle at most; a repeated key is an error.

    ``placed_by`` as in stack_by_key()."""
    return only_keys(sides_by_key(left, right, keys, suffixes, placed_by), keys)


def outer_join_all(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of any number of tables on one key, measures suffixed by source.

    One shuffle, however many tables; a key that a table has twice is an error.
    """
    grouped = only_keys(stack_by_key(frames, [key]), [key])
    columns = [
        F.col(quoted(name))[c].alias(f"{c}_{name}") for name, df in frames.items() for c in df.columns if c != key
    ]
    return grouped.select(quoted(key), *columns)


def lookup_last(
    df: DataFrame,
    dimension: DataFrame,
    key: str,
    dimension_key: str,
    values: dict[str, str],
    order_by: Sequence[Column | str],
) -> DataFrame:
    """Left join on a key regardless of case; of repeated entries the last one in order counts."""
    entry = F.struct(*[F.col(quoted(c)).alias(f"v{i}") for i, c in enumerate(values)])
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    last = dimension.groupBy(F.lower(F.col(quoted(dimension_key))).alias("lookup key")).agg(
        F.max_by(entry, place).alias("entry")
    )
    found = df.join(last, F.lower(F.col(quoted(key))) == F.col("`lookup key`"), "left")
    return found.select(
        *[quoted(c) for c in df.columns],
        *[F.col(f"entry.v{i}").alias(new) for i, new in enumerate(values.values())],
    )


def only_in(df: DataFrame, population: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are in the population; a missing key is in it if it has a missing one.

    Whether it has one is looked up first. If not, keys are joined as they are, and the rows then lie by them for later steps.
    """
    chosen = population.select(*[F.col(quoted(k)).alias(f"chosen {k}") for k in keys])
    missing = reduce(lambda a, b: a | b, [F.col(quoted(c)).isNull() for c in chosen.columns])
    pairs = [(df[quoted(k)], chosen[quoted(f"chosen {k}")]) for k in keys]
    if chosen.where(missing).isEmpty():
        same = [a == b for a, b in pairs]
    else:
        same = [a.eqNullSafe(b) for a, b in pairs]
    return df.join(chosen, reduce(lambda a, b: a & b, same), "left_semi")


def sample_population(
    df: DataFrame, keys: Sequence[str], size: int, seed: str = ""
) -> DataFrame:
    """A reproducible random sample of keys: the smallest hashes.

    Found by radix selection, so that no task holds or merges the sample: the distinct keys are written with their hashes,
    and the numbers of keys by the first digits of the hash (at most 65,536 numbers on the driver) tell which bins are in
    as a whole and in which one the sample ends. That one is counted by its next digits, until it holds at most
    ``LAST_BIN`` keys; only these are sorted.
    """
    if size < 1:
        return df.select(*map(quoted, keys)).limit(0)
    text = F.concat_ws("|", F.lit(seed), *[F.col(quoted(k)).cast("string") for k in keys])
    names = [quoted(k) for k in keys]
    distinct = df.select(*names).distinct()
    hashed = written(distinct.withColumn("its hash", F.md5(text.cast("binary"))), "hashed")
    digits = F.col("`its hash`")
    needed, bin_of_end = size, ""
    for length in range(DIGITS, MD5_DIGITS + 1, DIGITS):
        inside = hashed.where(digits.startswith(bin_of_end))
        counts = inside.groupBy(F.substring(digits, 1, length).alias("bin")).count().collect()
        for found, n in sorted(counts):
            if n > needed:
                bin_of_end = found
                break
            needed -= n
        else:  # the sample is as large as the table
            return hashed.select(*names)
        if n <= LAST_BIN or not needed:
            break
    sample = hashed.where(digits < bin_of_end)
    if needed:
        last = hashed.where(digits.startswith(bin_of_end)).orderBy(digits, *names).limit(needed)
        sample = sample.unionByName(last)
    return sample.select(*names)
