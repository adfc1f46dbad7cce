"""What the plans look like, not what they return."""

import re

import pytest
from conftest import SF

from __spark_entry__ import queries
from lodgeframe import views
from lodgeframe.operators import revenue as rev
from lodgeframe.operators.profile import METRICS, profile_table
from lodgeframe.views import END, START


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON_NODES = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"]
SHOWN = [
    "rev_prop_revenue", "rev_txn_flags", "var_compare_levels", "profile_table_lineitem",
    "cmp_cell_diff", "cmp_tidy", "cmp_s2t_stack", "ddl_final_profile", "txt_non_ascii_chars",
    "win_row_number", "agg_hierarchy",
]


@pytest.mark.parametrize("name", SHOWN)
def test_no_python_and_no_cross_product(spark, name):
    plan = physical(queries()[name](spark, SF))
    assert not [n for n in PYTHON_NODES if n in plan]
    assert "CartesianProduct" not in plan


def test_transactions_are_read_once_and_bounded_at_the_scan(spark, tmp_path):
    tables = views.stay_tables(spark, SF)
    path = str(tmp_path / "txn")
    tables.transactions.write.parquet(path)
    transactions = spark.read.parquet(path)
    tables = rev.StayTables(
        tables.checkout_curr, tables.checkout_detail, tables.booking_curr, tables.booking,
        transactions, tables.fx_rates,
    )
    df = rev.property_revenue(
        rev.stay_revenue(tables, START, END), rev.plan_rates(tables.fx_rates), rev.VERSIONS
    )
    plan = physical(df)
    scans = [line for line in plan.splitlines() if "FileScan" in line and path in line]
    assert len(scans) == 1
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", scans[0])
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    block = formatted[formatted.index(path) :]
    filters = re.search(r"PushedFilters: \[(.*)\]", block).group(1)
    assert "GreaterThanOrEqual(extract_last_update_dtm,ScalarSubquery" in filters
    assert "LessThanOrEqual(extract_last_update_dtm,ScalarSubquery" in filters
    assert "GreaterThanOrEqual(charge_category,room)" in filters
    assert pushed is None or "charge_category" in pushed.group(1)


def test_flagship_sums_before_it_joins_rates(spark):
    tables = views.stay_tables(spark, SF)
    df = rev.property_revenue(
        rev.stay_revenue(tables, START, END), rev.plan_rates(tables.fx_rates), ["v4"]
    )
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    first_join = optimized.index("Join LeftOuter")
    assert "Aggregate [prop_cd" in optimized[first_join:].splitlines()[1]
    # all sums are of fixed width, so nothing is sorted to be grouped
    assert not re.search(r"SortAggregate\(key=\[[^\]]", physical(df))


def test_profile_passes(spark):
    df = views.read(spark, SF, "part")
    plain = [m for m in METRICS if m not in (
        "count_of_distinct_values", "value_with_avg_length_of_characters")]
    plan = physical(profile_table(df, plain))
    assert plan.count("FileScan") == 1 and "Expand" not in plan
    # the first pass went into the checkpoint; the other two are here, the last one
    # split into columns of whole numbers, of other numbers and of text
    scans = [s for s in physical(profile_table(df)).splitlines() if "FileScan" in s]
    read = [re.search(r"ReadSchema: struct<(.*?)>", s).group(1) for s in scans]
    texts = "p_name:string,p_brand:string,p_type:string"
    assert sorted(read) == sorted(
        [texts, texts, "p_partkey:bigint,p_size:int", "p_retailprice:double"]
    )
    once = physical(profile_table(df, columnar=False))
    assert once.count("FileScan") == 2


def test_profile_reads_only_what_it_needs(spark):
    df = views.read(spark, SF, "lineitem").select("l_quantity", "l_returnflag")
    scan = [s for s in physical(profile_table(df, ["max_value"])).splitlines() if "FileScan" in s]
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in scan[0]


def test_numbering_has_no_single_partition_over_rows(spark):
    df = views.read(spark, SF, "orders").select("o_orderkey", "o_custkey")
    from lodgeframe.operators.sets import number_rows

    plan = physical(number_rows(df, ["o_custkey"], []))
    window = plan[plan.index("Window") :]
    # the window runs over one row per partition, made by an aggregate below it
    assert "HashAggregate" in window
    assert "parquet" in plan


def test_windows_filter_reaches_the_detail_scan(spark, tmp_path):
    path = str(tmp_path / "detail")
    views.checkout_detail(spark, SF).write.parquet(path)
    detail = spark.read.parquet(path)
    df = rev.filter_status(rev.filter_overlap(detail, START, END)).select("stay_id")
    scan = [line for line in physical(df).splitlines() if "FileScan" in line][0]
    assert "LessThanOrEqual(arrival_dt,1998-06-30)" in scan


def test_transactions_of_a_stay_are_dealt_to_several_tasks(spark):
    df = rev.stay_revenue(views.stay_tables(spark, SF), START, END)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    salted = [s for s in plan.splitlines() if "SortMergeJoin" in s and "salt#" in s]
    assert len(salted) == 1
    # the sums are shuffled on their own keys, not left where the join put them
    assert re.search(r"Exchange hashpartitioning\(prop_cd#\d+, stay_id#", plan)


def test_flags_read_the_transactions_once(spark, tmp_path):
    tables = views.stay_tables(spark, SF)
    path = str(tmp_path / "txn")
    tables.transactions.write.parquet(path)
    tables = rev.StayTables(
        tables.checkout_curr, tables.checkout_detail, tables.booking_curr, tables.booking,
        spark.read.parquet(path), tables.fx_rates,
    )
    before = rev.written
    plans = []
    rev.written = lambda df, name: plans.append(physical(df)) or before(df, name)
    try:
        df = rev.transaction_flags(tables, START, END)
    finally:
        rev.written = before
    plan = physical(df)
    assert path not in plan and len(plans) == 1
    assert len([s for s in plans[0].splitlines() if "FileScan" in s and path in s]) == 1
    assert not re.search(r"SortAggregate\(key=\[[^\]]", plan + plans[0])
    assert "salt#" in plans[0]


@pytest.mark.parametrize("name", ["join_outer_grain", "join_outer_versions", "join_outer_nway"])
def test_tables_meet_in_one_shuffle(spark, name):
    plan = physical(queries()[name](spark, SF))
    above = plan[: plan.index("Union")]
    # one exchange above the union of the tables at most, none where they lie by key already; no joins
    assert len(re.findall("Exchange", above)) <= 1 and "Join" not in above


def test_values_by_length_are_not_sorted(spark):
    plan = physical(queries()["win_first_with_len"](spark, SF))
    assert "SortAggregate" not in plan
    # what is sorted has the least length, and one row a group leaves each task
    assert plan.count("WindowGroupLimit") == 2 and "BroadcastHashJoin" in plan
    assert "Sort" not in plan[plan.index("BroadcastHashJoin") :]
    # without groups an aggregate of texts keeps one row; the only sort is that of the report's rows
    profile = physical(profile_table(views.read(spark, SF, "part")))
    assert not re.search(r"SortAggregate\(key=\[[^\]]", profile)


def test_only_the_last_bin_of_a_sample_is_sorted(spark):
    from lodgeframe.operators.joins import sample_population

    plan = physical(sample_population(spark.range(200_000), ["id"], 50_000))
    limit = int(re.search(r"TakeOrderedAndProject\(limit=(\d+)", plan).group(1))
    assert limit < 100 and plan.count("Sort") == 0 and "Exchange" not in plan
