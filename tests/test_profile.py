import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodgeframe.operators import ddl, profile
from lodgeframe.operators.profile import (
    COLUMNS,
    METRICS,
    count_distinct,
    merge_profiles,
    profile_table,
)

TEXTS = ["", " ", " a", "a ", " a", "\t", "a ", "é", "\U0001f600", None]


def by_field(df):
    return {r["field"]: r.asDict() for r in df.collect()}


def test_every_metric(spark):
    df = spark.createDataFrame(
        [(i, t, None, i / 2) for i, t in enumerate(TEXTS)], "n int, t string, nil string, x double"
    )
    got = by_field(profile_table(df))
    assert list(got) == ["n", "t", "nil", "x"]
    assert got["t"] == {
        "field": "t",
        "data_type": "String",
        "row_count": 10,
        "null_count": 1,
        "is_completely_null": "no",
        "character_blank_count": 1,
        "min_value": "",
        "min_length_of_characters": 0,
        "value_with_min_length_of_characters": "",
        "max_value": "\U0001f600",
        "max_length_of_characters": 2,
        "value_with_max_length_of_characters": " a",
        "max_octet_length": 4,
        "value_with_max_octet_length": "a ",
        "avg_length_of_characters": 2,
        "value_with_avg_length_of_characters": " a",
        "count_of_distinct_values": 10,
        "count_of_values_with_leading_whitespace": 4,
        "count_of_values_with_ending_whitespace": 4,
        "count_of_values_with_beginning_and_ending_whitespace": 2,
    }
    assert got["nil"]["is_completely_null"] == "yes"
    assert got["nil"]["count_of_distinct_values"] == 1
    assert got["nil"]["value_with_avg_length_of_characters"] is None
    assert got["n"]["data_type"] == "Int64" and got["x"]["data_type"] == "Float64"
    assert got["n"]["min_length_of_characters"] is None
    assert got["n"]["character_blank_count"] is None
    assert (got["n"]["min_value"], got["n"]["max_value"]) == ("0", "9")


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", " b")], ["it's `q`", "back\\slash.x"])
    got = by_field(profile_table(df))
    assert list(got) == df.columns
    assert got["it's `q`"]["value_with_avg_length_of_characters"] == "a"
    assert got["back\\slash.x"]["count_of_values_with_leading_whitespace"] == 1


def test_average_length_without_such_a_value(spark):
    df = spark.createDataFrame([("a",), ("bbbbb",)], "t string")
    got = by_field(profile_table(df))["t"]
    assert got["avg_length_of_characters"] == 3
    assert got["value_with_avg_length_of_characters"] is None


def test_switches(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    got = profile_table(df, ["null_count", "value_with_avg_length_of_characters"])
    assert got.columns == [
        "field", "data_type", "null_count", "value_with_avg_length_of_characters",
    ]
    assert rows(got) == [("t", "String", 1, "a")]
    with pytest.raises(ValueError):
        profile_table(df, ["no_such_metric"])


def test_wide_tables_take_several_passes(spark):
    df = spark.range(5).select(*[(F.col("id") * i).alias(f"c.{i}") for i in range(120)])
    got = profile_table(df, ["row_count", "max_value", "count_of_distinct_values"])
    found = [tuple(r) for r in got.collect()]
    assert [r[0] for r in found] == [f"c.{i}" for i in range(120)]
    assert found[7] == ("c.7", "Int64", 5, "28", 5)
    assert found[0][4] == 1


def test_distinct_tells_long_values_apart(spark):
    long = "x" * 500
    values = [long, long + "a", long + "b", long, "x" * 31, "x" * 32, None, None, ""]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert count_distinct(df).collect()[0]["count_of_distinct_values"] == 7


def test_distinct_with_a_hot_value(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("v")
    )
    assert count_distinct(df).collect()[0]["count_of_distinct_values"] == df.distinct().count()


def test_distinct_is_the_same_for_text_sources(spark):
    df = spark.range(100).select(
        F.col("id"),
        (F.col("id") % 7 / 2).alias("x"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 5)).alias("s"),
        (F.col("id") % 2 == 0).alias("b"),
    )
    assert rows(count_distinct(df)) == rows(count_distinct(df, columnar=False))
    assert rows(count_distinct(df)) == [(0, 100), (1, 7), (2, 6), (3, 2)]


# ---------------------------------------------------------------- merging


def profile_row(spark, **values):
    base = dict.fromkeys(COLUMNS)
    base.update(
        field="f", data_type="String", row_count=1, null_count=0, is_completely_null="no",
        count_of_distinct_values=1,
    )
    base.update(values)
    schema = ", ".join(f"{c} {METRICS.get(c, 'string')}" for c in COLUMNS)
    return spark.createDataFrame([tuple(base[c] for c in COLUMNS)], schema)


def merged(spark, a, b, **options):
    got = merge_profiles([profile_row(spark, **a), profile_row(spark, **b)], **options)
    return by_field(got)["f"]


def test_merge_rules(spark):
    a = dict(
        row_count=10, null_count=1, character_blank_count=2, min_value="b", max_value="b",
        min_length_of_characters=3, value_with_min_length_of_characters="aaa",
        max_length_of_characters=5, value_with_max_length_of_characters="first",
        max_octet_length=5, value_with_max_octet_length="first",
        avg_length_of_characters=4, value_with_avg_length_of_characters="four",
        count_of_distinct_values=4, is_completely_null="yes",
        count_of_values_with_leading_whitespace=7,
    )
    b = dict(
        row_count=5, null_count=5, character_blank_count=None, min_value="", max_value="z",
        min_length_of_characters=0, value_with_min_length_of_characters="",
        max_length_of_characters=5, value_with_max_length_of_characters="later",
        max_octet_length=6, value_with_max_octet_length="ééé",
        avg_length_of_characters=5, value_with_avg_length_of_characters=None,
        count_of_distinct_values=5, is_completely_null="yes",
        count_of_values_with_leading_whitespace=3,
    )
    got = merged(spark, a, b)
    assert got["file_count"] == 2 and got["row_count"] == 15 and got["null_count"] == 6
    assert got["is_completely_null"] == "yes"
    assert got["character_blank_count"] == 2
    assert (got["min_value"], got["max_value"]) == ("b", "z")
    assert got["min_length_of_characters"] == 0
    assert got["value_with_min_length_of_characters"] == "aaa"
    assert got["value_with_max_length_of_characters"] == "first"
    assert got["value_with_max_octet_length"] == "ééé"
    assert got["avg_length_of_characters"] == 5
    assert got["value_with_avg_length_of_characters"] == "four"
    assert got["count_of_distinct_values"] == 5
    assert got["count_of_values_with_leading_whitespace"] == 7


@pytest.mark.parametrize(
    "types, expected",
    [
        (("Int64", "Int64"), "Int64"),
        (("Float64", "Int64"), "Float64"),
        (("String", "Int64"), "String"),
        (("Float64", "String"), None),
        (("Boolean", "Int64"), None),
    ],
)
def test_merged_types(spark, types, expected):
    a, b = ({"data_type": t} for t in types)
    assert merged(spark, a, b, on_conflict="null")["data_type"] == expected
    if expected is None:
        with pytest.raises(ValueError):
            merged(spark, a, b)


def test_numbers_are_compared_as_numbers(spark):
    a, b = dict(data_type="Int64", min_value="9", max_value="9"), dict(
        data_type="Int64", min_value="10", max_value="10"
    )
    got = merged(spark, a, b)
    assert (got["min_value"], got["max_value"]) == ("9", "10")


def test_fields_of_later_files(spark):
    frames = [profile_row(spark), profile_row(spark).union(profile_row(spark, field="g"))]
    assert [r["field"] for r in merge_profiles(frames).collect()] == ["f"]
    assert [r["field"] for r in merge_profiles(frames, fields="union").collect()] == ["f", "g"]


def test_merge_agrees_with_profile_of_the_union(spark):
    a = spark.createDataFrame([("x", 1), ("yyy", 22)], "t string, n int")
    b = spark.createDataFrame([(None, 3), ("zzzzz", 4), ("", 5)], "t string, n int")
    both = by_field(profile_table(a.union(b)))
    got = by_field(merge_profiles([profile_table(a), profile_table(b)]))
    for field in ("t", "n"):
        for m in METRICS:
            if m.startswith(("row_", "null_", "min_l", "max_l", "max_o", "character_")):
                assert got[field][m] == both[field][m], (field, m)
    assert (got["n"]["min_value"], got["n"]["max_value"]) == ("1", "22")


# ---------------------------------------------------------------- DDL


def test_ddl_types(spark):
    from lodgeframe.functions import types as ft

    cases = [
        # data type, target, transform, chars, octets -> source, target, with headroom
        ("Int64", None, None, None, None, "integer", "integer", "integer"),
        ("UInt8", "string", None, None, None, "integer", "string", "string"),
        ("Float64", None, None, None, None, "float", "float", "float"),
        ("String", "date", None, 10, 10, "date", "date", "date"),
        ("String", "date", "parse", 10, 10, "string", "date", "date"),
        ("String", None, None, 10, 12, "string", "varchar(12)", "varchar(15)"),
        ("String", None, None, 10, None, "string", "varchar(10)", "varchar(12)"),
        ("String", "string", None, 10, 10, "string", "varchar(10)", "varchar(12)"),
        ("String", "integer", None, 10, 10, "string", "integer", "integer"),
        ("String", None, None, None, None, "string", None, None),
        ("Boolean", None, None, 3, 3, "string", "varchar(3)", "varchar(4)"),
    ]
    df = spark.createDataFrame(
        [(i, *c[:5]) for i, c in enumerate(cases)],
        "i int, t string, target string, transform string, chars int, octets int",
    ).withColumn("source", ft.source_type(F.col("t"), F.col("target"), F.col("transform")))
    sides = (F.col("source"), F.col("target"), F.col("chars"), F.col("octets"))
    got = df.orderBy("i").select(
        "source", ft.target_type(*sides), ft.target_type(*sides, headroom=1.2)
    )
    assert [tuple(r) for r in got.collect()] == [c[5:] for c in cases]


def dictionary(spark, data):
    types = ["int"] + ["string"] * 7
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(ddl.DICTIONARY_COLUMNS, types))
    return spark.createDataFrame(data, schema)


def test_dictionary(spark):
    marks = [
        "Y", "n", "Y (only scans that have a reshop)", "Y (except for clickbait lines - Null)",
        "other", None,
    ]
    data = [
        (i, "S", f"F{i}", t, length, mark, "e", "d")
        for i, (t, length, mark) in enumerate(
            zip(["String", "DOUBLE", "Int", "Date", "string", "float"],
                ["50", "9", None, "7", "n/a", "1"], marks)
        )
    ]
    overwrite = spark.createDataFrame(
        [("S", "F3", "varchar")], "Filename string, `Field Name` string, data_type_overwrite string"
    )
    got = ddl.process_dictionary(dictionary(spark, data), overwrite).orderBy("`Item No.`").collect()
    assert [r["data_type_new"] for r in got] == [
        "varchar", "double precision", "integer", "varchar", "varchar", "double precision",
    ]
    assert [r["char_max_length"] for r in got] == [50, None, None, 7, None, None]
    assert [r["is_required_for_reporting"] for r in got] == [
        "yes", "no", "yes partial, if scans have a reshop",
        "yes partial, if clickbait lines are not null", None, None,
    ]
    with pytest.raises(ValueError):
        ddl.process_dictionary(dictionary(spark, data).drop("Example"), overwrite)


def test_final_profile(spark):
    profile = merge_profiles(
        [profile_row(spark, field="Name", max_length_of_characters=10, max_octet_length=10)]
    )
    entries = dictionary(
        spark,
        [
            (1, "Test Reservation", "NAME", "String", "20", "N", "", "old"),
            (2, "Test Reservation", "name", "String", "30", "Y", "", "New Text"),
            (3, "Other", "name", "Int", None, "Y", "", "not this"),
        ],
    )
    overwrite = spark.createDataFrame(
        [], "Filename string, `Field Name` string, data_type_overwrite string"
    )
    targets = spark.createDataFrame(
        [("TestReservation", "NAME", None, "trim", "x")],
        "data_subject string, field string, data_type_new string, transform_needed string, "
        "source_format string",
    )
    final = ddl.final_profile(
        profile, ddl.process_dictionary(entries, overwrite), targets, "TestReservation"
    )
    assert final.columns == ddl.FINAL_COLUMNS and len(final.columns) == 31
    got = final.collect()[0]
    assert got["target_data_type"] == "varchar(10)"
    assert got["target_data_type_with_20_pct_buffer"] == "varchar(12)"
    assert got["data dict description"] == "new text"
    assert got["data dict char_max_length"] == 30
    assert got["is_required_field"] == "yes"
    assert got["is_required_for_business_reporting"] == "yes"
    assert (got["transform_needed"], got["source_format"]) == ("trim", "x")
    assert ddl.column_definitions(spark).count() == 3


def test_characters(spark):
    df = spark.createDataFrame([(1, "aé\U0001f600"), (2, "abc"), (3, None)], "i int, t string")
    assert rows(ddl.character_bytes(df, "t", only_non_ascii=True)) == [
        (1, 2, "é", "C3A9", 2),
        (1, 3, "\U0001f600", "F09F9880", 4),
    ]
    assert ddl.character_bytes(df, "t").count() == 6
    assert rows(ddl.non_ascii_values(df, "t").select("i")) == [(1,)]
    assert rows(ddl.values_of_octet_length(df, "t", 3)) == [("abc",)]


# -- all files of a subject in one run


def test_files_are_profiled_like_single_tables(spark):
    data = [
        ("b.csv", 1, "x", 1.5), ("b.csv", 2, " yy", None), ("b.csv", 2, "yy ", 0.5), ("a.csv", None, "", 2.0),
        ("a.csv", 5, None, 2.0), (None, 7, "zzz", None), ("c.csv", None, None, None),
    ]
    df = spark.createDataFrame(data, "file string, n int, s string, x double")
    found = profile.profile_files(df, "file")
    for name in ("a.csv", "b.csv", "c.csv", None):
        own = df.where(F.col("file").eqNullSafe(F.lit(name))).drop("file")
        got = found.where(F.col("file").eqNullSafe(F.lit(name))).drop("file")
        assert rows(got) == rows(profile.profile_table(own, position=True))
    some = profile.profile_files(df, "file", ["null_count", "value_with_avg_length_of_characters"])
    assert some.columns == ["file", "position", "field", "data_type", "null_count", "value_with_avg_length_of_characters"]
    assert rows(found.select("file").distinct()) == [("a.csv",), ("b.csv",), ("c.csv",), (None,)]


def test_merged_files_keep_the_order_of_columns(spark):
    df = spark.createDataFrame([(f"f{i}", i, str(i)) for i in range(20)], "file string, zz int, aa string")
    merged = profile.merge_file_profiles(profile.profile_files(df, "file"), "file", ["f3"]).collect()
    assert [(r["field"], r["file_count"], r["row_count"]) for r in merged] == [("zz", 20, 20), ("aa", 20, 20)]
    # of values of one length that of the first file in order
    assert merged[1]["value_with_min_length_of_characters"] == "3"
    profiles = [profile.profile_table(df.drop("file"), position=True).orderBy("field")]
    assert [r["field"] for r in profile.merge_profiles(profiles).collect()] == ["zz", "aa"]


def test_jobs_do_not_grow_with_files(spark):
    jobs = []
    for number in (3, 200):
        df = spark.range(400).select(F.concat(F.lit("f"), F.col("id") % number).alias("file"), "id", F.col("id").cast("string").alias("s"))
        group = f"profiles-{number}"
        spark.sparkContext.setJobGroup(group, group)
        merged = profile.merge_file_profiles(profile.profile_files(df, "file"), "file").collect()
        spark.sparkContext.setJobGroup("other", "other")
        assert [r["file_count"] for r in merged] == [number, number]
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    assert max(jobs) - min(jobs) <= 2
