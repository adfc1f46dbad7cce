"""How often the rows of large tables are shuffled and written, whatever their size."""

import re

import pytest
from conftest import SF
from test_plans import physical

from __spark_entry__ import queries
from lodgeframe.operators import compare as cmp
from lodgeframe.operators import joins, sets
from lodgeframe.plans import reconciliation as recon


def plans_of(spark, monkeypatch, name):
    """The plans of the tables that a query writes and of its result, where no table is small enough to be sent to all tasks."""
    found = []
    for module in (cmp, joins, recon, sets):
        write = getattr(module, "written", None)
        if write is not None:
            kept = lambda df, what, write=write: found.append((what, physical(df))) or write(df, what)
            monkeypatch.setattr(module, "written", kept)
    # a population of many keys
    monkeypatch.setattr(recon, "FEW_KEYS", 10, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found.append(("result", physical(queries()[name](spark, SF))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return found


# tables written, shuffles by ranges (whose input is computed twice), and shuffles of any kind, at most
LIMITS = {
    "agg_run_summary": (["paired"], 0, 8),
    "agg_variance_summary": (["sides"], 0, 5),
    "cmp_tidy": (["paired"], 0, 3),
    "cmp_notes": (["sides", "cells"], 0, 17),
    "cmp_population_matrix": (["sides", "cells"], 0, 5),
    "join_positional": ([], 0, 2),
    "cmp_s2t_stack": (["sides"], 0, 2),
    "cmp_environment_cells": (["sides", "cells"], 0, 4),
    "cmp_environment_columns": (["sides", "cells"], 0, 10),
}


@pytest.mark.parametrize("name", LIMITS)
def test_shuffles_and_tables(spark, monkeypatch, name):
    found = plans_of(spark, monkeypatch, name)
    tables, by_range, most = LIMITS[name]
    plans = "\n".join(plan for _, plan in found)
    counts = [what for what, _ in found[:-1]], len(re.findall("Exchange rangepartitioning", plans)), len(re.findall("Exchange hashpartitioning", plans))
    assert counts[0] == tables and counts[1] <= by_range and counts[2] <= most
    # what is summed is not sorted before it is shuffled
    for plan in (p for w, p in found if w in ("paired", "sides") or name == "join_positional"):
        lines = plan.splitlines()
        below = [lines[i + 1] for i, s in enumerate(lines[:-1]) if "Exchange hashpartitioning(l_orderkey" in s]
        assert below and not any("SortAggregate" in s for s in below)
