import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodgeframe.functions import dates
from lodgeframe.functions import text as tx
from lodgeframe.operators import joins, sets, shape


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Keep_Me", "room_rev_abc_v1", "x_y"])
    assert shape.rename_upper_source(df, "room", ["Keep_Me"]).columns == [
        "Keep_Me", "room rev ABC v1", "x y",
    ]
    assert shape.lower_names(df.toDF("A.1", "B", "c")).columns == ["a", "b", "c"]
    assert shape.select_existing(df, ["x_y", "no", "Keep_Me"]).columns == ["x_y", "Keep_Me"]
    assert shape.suffix_all_but(df, ["x_y"], "_s").columns == [
        "Keep_Me_s", "room_rev_abc_v1_s", "x_y",
    ]
    with pytest.raises(ValueError):
        shape.rename_upper_source(df.toDF("a", "room_rev", "c"), "room")


def test_to_numeric_and_fill(spark):
    df = spark.createDataFrame([("1.256", "x"), ("bad", None), ("NaN", "y")], "a string, b string")
    got = shape.fill(shape.to_numeric(df, {"a": 2}), {"b": "Unknown"})
    assert rows(got) == [(1.26, "x"), (None, "Unknown"), (None, "y")]


def test_all_in(spark):
    df = spark.createDataFrame([("0", "MATCH"), ("0", "1"), ("0", None)], "a string, b string")
    got = df.select(shape.all_in(["a", "b"], ["0", "MATCH"]))
    assert [r[0] for r in got.collect()] == [True, False, False]


def test_whitespace(spark):
    values = ["", " ", " a", "a ", "\u00a0a", "\ta", "a\u2028", "a\u3000", "\u00e9", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.orderBy("i").select(
        tx.starts_with_whitespace(F.col("v")), tx.ends_with_whitespace(F.col("v"))
    )
    assert [tuple(r) for r in got.collect()] == [
        (False, False), (True, True), (True, False), (False, True), (True, False), (True, False),
        (False, True), (False, True), (False, False), (None, None),
    ]


def test_plain_decimal(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (-2.5,), (1e-7,), (None,), (100.0,)], "v double")
    got = [r[0] for r in df.select(tx.plain_decimal(F.col("v"))).collect()]
    assert got == ["0", "5", "-2.5", "0.0000001", None, "100"]


def test_period(spark):
    df = spark.createDataFrame([(202402,), (202512,)], "p int")
    got = df.select(*[c.alias(n) for n, c in dates.period_columns(F.col("p")).items()]).collect()
    assert [str(x) for x in got[0]] == [
        "2024-02-01", "2024-02-29", "2024-02-01", "2024-02-29", "20240201", "20240229",
    ]
    assert got[1]["date_end_yyyymmdd"] == "20251231"


def test_file_names(spark):
    names = [
        "Users_20251224_chain.csv",
        "TestReservation_May-31st-2025_chain_correction_file.csv",
        "Parity_July-2nd-2025_x.csv",
        "plain.csv",
        "a_b_c.csv",
    ]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = df.orderBy("i").select(*dates.file_name_attributes(F.col("n")).values())
    assert [tuple(r) for r in got.collect()] == [
        ("Users", "20251224", "daily"),
        ("TestReservation", "20250531", "correction"),
        ("Parity", "20250702", "daily"),
        (None, None, None),
        ("a", None, "daily"),
    ]
    keys = spark.createDataFrame([("x (AB12 stay_id 77).csv",), ("other.csv",)], "n string")
    got = keys.select(*dates.stay_file_keys(F.col("n")).values()).collect()
    assert [tuple(r) for r in got] == [("AB12", "77"), (None, "other.csv")]


def test_outer_join_pairs_missing_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, v int")
    got = joins.outer_join_on(a, b, ["k"], ("_a", "_b"))
    assert rows(got) == [
        ("x", 2, None, True, False),
        ("y", None, 20, False, True),
        (None, 1, 10, True, True),
    ]


def test_lookup_last_wins_regardless_of_case(spark):
    df = spark.createDataFrame([("Name",), ("other",)], "field string")
    dim = spark.createDataFrame([(1, "NAME", "a"), (2, "name", None)], "n int, f string, v string")
    got = joins.lookup_last(df, dim, "field", "f", {"v": "value"}, ["n"])
    assert rows(got) == [("Name", None), ("other", None)]
    got = joins.lookup_last(df, dim, "field", "f", {"v": "value"}, [-F.col("n")])
    assert rows(got) == [("Name", "a"), ("other", None)]


def test_sample_is_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = joins.sample_population(df, ["k"], 20, "s")
    b = joins.sample_population(df.repartition(7), ["k"], 20, "s")
    assert rows(a) == rows(b) and a.count() == 20
    assert rows(joins.sample_population(df, ["k"], 20, "other")) != rows(a)


def test_number_rows_with_a_hot_group_and_equal_rows(spark):
    data = [("hot", i % 7) for i in range(2000)] + [("a", 3), ("a", 1), (None, 5), (None, 5)]
    df = spark.createDataFrame(data, "g string, v int").repartition(16)
    got = sets.number_rows(df, ["v"], ["g"]).collect()
    by_group = {}
    for g, v, n in got:
        by_group.setdefault(g, []).append((n, v))
    assert {g: len(x) for g, x in by_group.items()} == {"hot": 2000, "a": 2, None: 2}
    for found in by_group.values():
        found.sort()
        assert [n for n, _ in found] == list(range(1, len(found) + 1))
        assert [v for _, v in found] == sorted(v for _, v in found)


def test_number_rows_over_all(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v")).repartition(9)
    got = sets.number_rows(df, ["v"]).collect()
    assert sorted((r.v, r.row_num) for r in got) == [(i, i + 1) for i in range(500)]


def test_sets(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2,)], "i int")
    assert rows(sets.union_diagonal([a, b])) == [(1, "x"), (2, None)]
    names = [spark.createDataFrame([(n,) for n in s], "column_name string") for s in ("ab", "bc")]
    assert rows(sets.column_overlap(*names)) == [
        ("a", "test only"), ("b", "match"), ("c", "prod only"),
    ]
    long = sets.transpose_metrics(
        spark.createDataFrame([("n", 1, 2)], "metric string, p int, q int"), "metric"
    )
    assert rows(long) == [("n", "p", 1), ("n", "q", 2)]


def test_first_of_length(spark):
    data = [("g", "bb"), ("g", "c"), ("g", "a"), ("g", None), (None, ""), (None, "x"), ("n", None), ("n", None)]
    df = spark.createDataFrame(data + [("hot", "same")] * 500, "g string, v string").repartition(6)
    got = sets.first_of_length(df, ["g"], "v", F.length("v"), "v")
    assert rows(got) == sorted([("g", "a"), (None, ""), ("n", None), ("hot", "same")], key=repr)
    longest = sets.first_of_length(df, ["g"], "v", -F.length("v"), "longest")
    assert rows(longest) == sorted([("g", "bb"), (None, "x"), ("n", None), ("hot", "same")], key=repr)
    assert rows(sets.first_of_length(df, [], "v", F.length("v"), "v")) == [("",)]
    assert rows(sets.first_of_length(df.limit(0), ["g"], "v", F.length("v"), "v")) == []


@pytest.mark.parametrize("last_bin", [1, 40, 10_000])
@pytest.mark.parametrize("size", [0, 1, 37, 1000, 2000, 5000])
def test_sample_by_radix_selection(spark, monkeypatch, last_bin, size):
    monkeypatch.setattr(joins, "LAST_BIN", last_bin)
    monkeypatch.setattr(joins, "DIGITS", 1)
    df = spark.range(4000).selectExpr("if(id % 2 = 0, null, id) as a", "id % 7 as b", "id as other")
    distinct = {(r["a"], r["b"]) for r in df.collect()}
    text = {k: "|".join(["s", *[str(x) for x in k if x is not None]]) for k in distinct}
    order = sorted(distinct, key=lambda k: hashlib.md5(text[k].encode()).hexdigest())
    got = joins.sample_population(df, ["a", "b"], size, "s")
    assert rows(got) == sorted(order[:size], key=repr)


def test_sample_of_keys_with_one_hash(spark, monkeypatch):
    monkeypatch.setattr(joins, "LAST_BIN", 0)
    df = spark.createDataFrame([("x", None), (None, "x"), ("y", "z")], "a string, b string")
    sizes = [joins.sample_population(df, ["a", "b"], n).count() for n in range(4)]
    assert sizes == [0, 1, 2, 3]
    assert joins.sample_population(df.limit(0), ["a", "b"], 3).count() == 0
