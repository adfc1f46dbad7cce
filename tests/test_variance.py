import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodgeframe.functions import variance as fv
from lodgeframe.operators import variance as ov
from lodgeframe.operators.aggregates import hierarchy_levels
from lodgeframe.plans import comparison


def evaluate(spark, pairs, column):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_var_pct(spark):
    cases = [
        ((0.0, 0.0), 0.0), ((5.0, 0.0), 1.0), ((-5.0, 0.0), -1.0), ((5.0, -10.0), 0.5),
        ((-5.0, -10.0), -0.5), ((5.0, 10.0), 0.5), ((None, 10.0), None), ((5.0, None), None),
        ((None, 0.0), None),
    ]
    got = evaluate(spark, [c[0] for c in cases], fv.var_pct(F.col("a"), F.col("b")))
    assert got == [c[1] for c in cases]


def test_var_pct_from_to(spark):
    pairs = [(10.0, 15.0), (0.0, 3.0), (0.0, -3.0), (0.0, 0.0), (-10.0, -5.0), (None, 1.0)]
    got = evaluate(spark, pairs, fv.var_pct_from_to(F.col("a"), F.col("b")))
    assert got == [0.5, 1.0, -1.0, 0.0, 0.5, None]


@pytest.mark.parametrize("missing_from, new", [("one", 1.0), ("neg_to", -7.0)])
def test_var_pct_null_aware(spark, missing_from, new):
    pairs = [
        (None, None), (None, 7.0), (7.0, None), (0.0, 0.0), (0.0, 3.0), (-4.0, -6.0), (4.0, 6.0),
    ]
    got = evaluate(spark, pairs, fv.var_pct_null_aware(F.col("a"), F.col("b"), missing_from))
    assert got == [None, new, -1.0, 0.0, 1.0, 0.5, 0.5]


def test_var_pct_null_aware_checks_option():
    with pytest.raises(ValueError):
        fv.var_pct_null_aware(F.lit(1), F.lit(2), "other")


def test_buckets_at_every_bound(spark):
    expected = {
        -1.5: "< -100%", -1.0: "equals -100%", 0.0: "between -2% and 0%",
        0.85: "between 80% and 90%", 0.99: "between 90% and 100%", 1.0: "equals 100%",
        1.5: "> 100%", -0.95: "between -100% and -90%", 0.01: "between 0% and 2%",
    }
    for low, high in zip(fv.BUCKET_EDGES, fv.BUCKET_EDGES[1:]):
        if high < 100:
            expected[high / 100] = f"between {low}% and {high}%"
    cases = [*expected.items(), (None, None), (math.nan, None)]
    got = evaluate(spark, [(x, None) for x, _ in cases], fv.var_bucket(F.col("a")))
    assert got == [label for _, label in cases]


def test_bucket_order_is_complete_and_ordered():
    assert len(fv.BUCKET_ORDER) == len(set(fv.BUCKET_ORDER)) == 33
    assert fv.BUCKET_ORDER[:2] == ["< -100%", "equals -100%"]
    assert fv.BUCKET_ORDER[-2:] == ["equals 100%", "> 100%"]
    at = fv.BUCKET_ORDER.index("equals 0%")
    assert fv.BUCKET_ORDER[at - 1] == "between -2% and 0%"
    assert fv.BUCKET_ORDER[at + 1] == "between 0% and 2%"
    assert "between 80% and 90%" in fv.BUCKET_ORDER


def test_order_in_puts_unknown_last(spark):
    df = spark.createDataFrame([("b",), ("x",), (None,), ("a",)], "v string")
    got = df.select("v", fv.order_in(["a", "b"], F.col("v")).alias("n"))
    assert {r.v: r.n for r in got.collect()} == {"a": 1, "b": 2, "x": 3, None: 3}


@pytest.mark.parametrize("strict, differing", [(False, None), (True, "variance")])
def test_same_text(spark, strict, differing):
    df = spark.createDataFrame(
        [(1, None, None), (2, "a", None), (3, None, "a"), (4, "a", "A"), (5, "a", "b")],
        "i int, a string, b string",
    )
    got = df.orderBy("i").select(fv.same_text(F.col("a"), F.col("b"), strict))
    assert [r[0] for r in got.collect()] == [None, "variance", "variance", None, differing]


def test_distribution_share_counts_rows_without_bucket(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (None,), (-2.0,)], "p double")
    got = ov.variance_distribution(df, "p").collect()
    assert [tuple(r) for r in got] == [
        ("< -100%", 1, 0.25),
        ("between 40% and 50%", 2, 0.5),
    ]


def extract(spark, data):
    return spark.createDataFrame(
        data,
        "prop_cd string, country_cd string, country_desc string, op_area_level2_desc string, "
        "room_nights double, chkout_room_usd_amt double",
    )


def test_compare_levels_pairs_missing_countries(spark):
    to = extract(
        spark,
        [("A", "1", "one", "R", 10.0, 100.0), ("B", None, None, None, 4.0, 40.0)],
    )
    base = extract(
        spark,
        [("A", "1", "one", "R", 8.0, 50.0), ("B", None, None, None, 4.0, 20.0),
         ("C", "2", "two", "R", 1.0, -10.0)],
    )
    levels = comparison.compare_levels(to, base, "room")
    props = {r["prop_cd"]: r for r in levels["prop_cd"].collect()}
    assert len(props) == 3
    assert props["B"]["country_cd"] == "Unknown"
    assert props["B"]["room rev var pct"] == 1.0
    assert props["C"]["room rev v2"] == 0.0
    assert props["C"]["room rev var pct"] == 1.0
    total = levels["total"].collect()
    assert len(total) == 1
    assert total[0]["room rev v2"] == 140.0
    assert total[0]["room rev var amt"] == 80.0
    for name in ("country", "op_area_level2_desc", "prop_cd"):
        assert sum(r["room rev v1"] for r in levels[name].collect()) == 60.0
    assert {r["op_area_level2_desc"] for r in levels["op_area_level2_desc"].collect()} == {
        "R", "Unknown",
    }


def test_compare_sources_drops_unknown_hierarchy_above_property(spark):
    def source(data):
        return spark.createDataFrame(data, "prop_cd string, room_nights double, room_rev_usd double")

    hierarchy = spark.createDataFrame(
        [("A", "R", "1", "one")],
        "prop_cd string, op_area_level2_desc string, country_cd string, country_desc string",
    )
    result = comparison.compare_sources(
        {"x": source([("A", 1.0, 10.0), ("B", 1.0, 5.0)]), "y": source([("A", 2.0, 15.0)])},
        hierarchy,
    )
    props = {r["prop_cd"]: r for r in result["prop_cd"].collect()}
    assert props["A"]["room_rev_usd_var_pct_y_vs_x"] == 0.5
    assert props["A"]["room_rev_usd_var_pct_y_vs_x_distribution"] == "between 40% and 50%"
    assert props["B"]["room_rev_usd_y"] == 0.0
    assert [r["country_cd"] for r in result["country"].collect()] == ["1"]
    dist = [tuple(r) for r in result["y_vs_x_var_pct_dist"].collect()]
    assert dist == [("equals -100%", 1, 0.5), ("between 40% and 50%", 1, 0.5)]


def test_hierarchy_levels_add_up(spark):
    df = spark.createDataFrame(
        [("R1", "c1", 1.5), ("R1", "c2", 2.5), ("R2", None, 4.0)], "r string, c string, m double"
    )
    kept = hierarchy_levels(df, {"c": ["r", "c"], "r": ["r"], "all": []}, ["m"], "Unknown")
    assert rows(kept["r"]) == [("R1", 4.0), ("R2", 4.0)]
    assert rows(kept["all"]) == [(8.0,)]
    dropped = hierarchy_levels(df, {"c": ["r", "c"], "r": ["r"]}, ["m"], "drop")
    assert rows(dropped["r"]) == [("R1", 4.0)]


def test_pairwise_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    got = ov.pairwise_variance(df, {"x": "x", "y": "y", "z": "z"})
    assert [c for c in got.columns if c.endswith("amt")] == [
        "x vs. y var amt", "x vs. z var amt", "y vs. z var amt",
    ]
