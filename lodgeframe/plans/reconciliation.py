"""Reconciliation runs over a population of keys, each as one distributed job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodgeframe.functions.types import compare_type
from lodgeframe.operators.aggregates import run_summary, sum_by_rest, variance_counts, variance_matrix
from lodgeframe.operators.compare import (
    BAD_KEY,
    align_types,
    column_report,
    compare_cells,
    compare_tidy,
    flag_variance,
    has_unfit,
    keys_without_rows,
    map_columns,
    name_relation,
    select_columns,
    stack_sides,
    unfit_values,
)
from lodgeframe.operators.joins import only_in
from lodgeframe.operators.sets import union_all
from lodgeframe.operators.shape import quoted
from lodgeframe.sources.scratch import written

# A population of more keys is looked up for the rows that differ, not for all rows.
FEW_KEYS = 1_000_000


def compare_environments(
    test: DataFrame,
    prod: DataFrame,
    keys: Sequence[str],
    population: DataFrame,
    population_keys: Sequence[str],
    mapping: Mapping[str, str],
    warehouse_types: Mapping[str, str],
    measures: Sequence[str] = (),
    only_mapped: bool = False,
    placed_by: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Cells that differ between two environments for a population, with their summaries.

    Prod's columns get test's names, test is summed to prod's grain, both are
    cast to the same types, and the columns both have are compared, or with ``only_mapped`` those that have a mapping
    (and the keys). ``columns`` is the report of which columns exist where.

    What could not be compared does not end the run, it is in ``notes``: values that do not fit their type (they are compared
    as their own text, and left out of sums), rows left out because a key does not fit, and keys of the population
    without rows on a side. The notes are computed when they are used.

    ``placed_by`` as in stack_by_key(). Rows are limited to the population before they are compared if it has few keys,
    and else after that, when only those that differ are left.
    """
    mapped = test.sparkSession.createDataFrame(list(mapping.items()), "old string, new string")
    report = column_report(name_relation(test), name_relation(prod), mapped)
    # as many rows as there are columns
    chosen = {r["column_name"] for r in select_columns(report, only_mapped).collect()}
    prod = map_columns(prod, mapping)
    absent = [k for k in keys if k not in test.columns or k not in prod.columns]
    if absent:
        raise ValueError(f"keys {absent} are not in both tables")
    shared = [c for c in test.columns if c in chosen or c in keys]
    columns = [c for c in shared if c not in keys]
    bad_key = has_unfit(keys, warehouse_types)
    few = population.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    sides, notes = {}, []
    for side, df in (("test", test), ("prod", prod)):
        df = df.select(*map(quoted, shared))
        notes.append(unfit_values(df, keys, keys, warehouse_types, side, BAD_KEY))
        df = df.where(~bad_key)
        typed = align_types(df.select(*map(quoted, keys)), warehouse_types).schema
        df = df.withColumns({k: F.col(quoted(k)).try_cast(typed[k].dataType) for k in keys})
        sides[side] = only_in(df, population, population_keys) if few else df
        unfit = unfit_values(sides[side], keys, columns, warehouse_types, side)
        notes.append(unfit if few else only_in(unfit, population, population_keys))
    notes.append(keys_without_rows(population, sides, keys, population_keys, warehouse_types))
    test, prod = sides.values()
    measures = [c for c in measures if c in columns]
    if measures:
        texts = [f.name for f in test.schema.fields if f.name in measures and isinstance(f.dataType, StringType)]
        numbers = {c: F.col(quoted(c)).try_cast(compare_type(warehouse_types.get(c, "double precision"))) for c in texts}
        test = sum_by_rest(test.withColumns(numbers) if numbers else test, measures)
    aligned = (align_types(df, warehouse_types, as_text=columns) for df in (test, prod))
    chosen_later = {} if few else {"population": population, "population_keys": population_keys}
    cells = written(compare_cells(*aligned, keys, columns, placed_by=placed_by, **chosen_later), "cells")
    return {
        "columns": report,
        "variance": cells,
        "matrix": variance_matrix(cells, population_keys, sorted(columns), population),
        "notes": union_all(notes),
    }


def positional_run(
    test: DataFrame,
    prod: DataFrame,
    population: DataFrame,
    group: Sequence[str],
    order_by: Sequence[str],
    small_groups: bool = False,
) -> dict[str, DataFrame]:
    """Every cell of a population compared by position, and the mismatches per key.

    Keys of the population without any row are in the summary, as missing in both and with no mismatch. The paired rows
    are written, cells are made of them where they are used. ``small_groups`` as in number_rows().
    """
    cells = compare_tidy(
        only_in(test, population, group), only_in(prod, population, group), group, order_by, small_groups
    )
    return {"comparison": cells, "summary": run_summary(cells, group, population)}


def source_against_target(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    population: DataFrame,
    population_keys: Sequence[str],
    exempt: Sequence[str],
    placed_by: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Stacked detail, flagged variance rows and counts per key, for a population.

    Rows of both sides are written, and stacked where they are used. ``placed_by`` as in stack_by_key().
    """
    detail = stack_sides(
        only_in(source, population, population_keys),
        only_in(target, population, population_keys),
        keys,
        placed_by=placed_by,
    )
    variance = flag_variance(detail, exempt)
    return {
        "detail": detail,
        "variance": variance,
        "summary": variance_counts(variance, population_keys),
    }
