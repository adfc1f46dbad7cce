import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodgeframe.operators import aggregates as agg
from lodgeframe.operators import compare as cmp
from lodgeframe.plans import reconciliation as recon


def table(spark, data, schema="k int, s string, x double"):
    return spark.createDataFrame(data, schema)


def test_cells(spark):
    test = table(
        spark,
        [(1, "a", 1.0), (2, None, 1.0), (3, None, 2.0), (4, "d", 1.0), (5, "e", None), (6, None, None)],
    )
    prod = table(
        spark,
        [(1, "a", 1.0 + 1e-11), (2, None, 1.0), (3, "c", 3.0), (4, "d", 1.0 + 1e-9), (7, "g", 7.0)],
    )
    got = rows(cmp.compare_cells(test, prod, ["k"]))
    assert got == [
        (3, "both", "s", None, "c"),
        (3, "both", "x", "2.0", "3.0"),
        (4, "both", "x", "1.0", "1.000000001"),
        (5, "test only", "s", "e", None),
        (7, "prod only", "s", None, "g"),
        (7, "prod only", "x", None, "7.0"),
    ]
    wide = rows(cmp.compare_wide(test, prod, ["k"], ["s", "x"]))
    assert wide == [(3, None, "c", 2.0, 3.0), (4, None, None, 1.0, 1.000000001)]


def test_compare_with_itself_is_empty(spark):
    df = table(spark, [(i, None if i % 3 else "v", i / 7) for i in range(50)])
    assert cmp.compare_cells(df, df, ["k"]).count() == 0
    tidy = cmp.compare_tidy(df, df, [], ["k"])
    assert tidy.filter("match = 'N'").count() == 0 and tidy.count() == 150
    flagged = cmp.flag_variance(cmp.stack_sides(df, df, ["k"]), ["k"])
    assert {r["is_variance"] for r in flagged.collect()} == {"no"}


def test_repeated_keys_are_refused(spark):
    df = table(spark, [(1, "a", 1.0), (1, "b", 1.0)])
    for run in (
        lambda: cmp.compare_cells(df, df, ["k"]),
        lambda: cmp.compare_wide(df, df, ["k"], ["s"]),
        lambda: cmp.stack_sides(df, df, ["k"]),
    ):
        with pytest.raises(ValueError, match="no key"):
            run()


def tidy(spark, test, prod, group=("g",), order=("n",)):
    return rows(cmp.compare_tidy(test, prod, list(group), list(order)))


def test_tidy_values(spark):
    schema = "g string, n int, v string"
    test = table(spark, [("a", 1, "007"), ("a", 2, None), ("a", 3, "x"), ("a", 4, None)], schema)
    prod = table(spark, [("a", 1, "7"), ("a", 2, None), ("a", 3, "y"), ("a", 4, "z")], schema)
    got = [r for r in tidy(spark, test, prod) if r[3] == "v"]
    assert got == [
        ("a", "1", 2, "v", "007", "7", 0.0, "Y"),
        ("a", "2", 2, "v", None, None, None, "Y"),
        ("a", "3", 2, "v", "x", "y", None, "N"),
        ("a", "4", 2, "v", None, "z", None, "N"),
    ]


def test_tidy_shapes_and_labels(spark):
    test = table(spark, [("a", 1, 2.0), ("a", 2, 3.0)], "g string, n int, v double")
    prod = table(spark, [("a", 1, 2.5, "z")], "g string, n int, w double, extra string")
    assert tidy(spark, test, prod) == [
        ("a", "1", 1, "n", "1", "1", 0.0, "Y"),
        ("a", "1", 2, "v / w", "2.0", "2.5", -0.5, "N"),
        ("a", "1", 3, "extra", "COLUMN MISSING IN TEST", "z", None, "N"),
        ("a", "2", 1, "n", "2", "ROW MISSING IN PROD", None, "N"),
        ("a", "2", 2, "v / w", "3.0", "ROW MISSING IN PROD", None, "N"),
        ("a", "2", 3, "extra", "COLUMN MISSING IN TEST", "ROW MISSING IN PROD", None, "N"),
        ("a", "ALL", None, "__COLUMN_COUNT__", "2", "3", -1.0, "N"),
        ("a", "ALL", None, "__ROW_COUNT__", "2", "1", 1.0, "N"),
    ]


def test_positional_run(spark):
    schema = "g string, n int, v double"
    test = table(spark, [("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0), ("t", 1, 1.0)], schema)
    prod = table(spark, [("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 9.0), ("p", 1, 1.0)], schema)
    population = table(spark, [("a",), ("b",), ("t",), ("p",), ("nothing",)], "g string")
    run = recon.positional_run(test, prod, population, ["g"], ["n"])
    assert rows(run["summary"]) == [
        ("a", "OK", 0), ("b", "OK", 1), ("nothing", "missing in both", 0),
        ("p", "missing in test", 3), ("t", "missing in prod", 3),
    ]
    assert run["comparison"].count() == 10


def test_stack(spark):
    schema = "k int, n int, x double, s string"
    source = table(spark, [(1, 5, 1.5, "a"), (2, None, 2.0, None), (3, 1, 1.0, "c")], schema)
    target = table(spark, [(1, 3, 1.5, "a"), (2, None, None, None), (4, 1, 1.0, "d")], schema)
    stacked = cmp.stack_sides(source, target, ["k"])
    assert rows(stacked.filter("row_source = 'VARIANCE'"), "k") == [
        (1, "VARIANCE", "2", "0", "MATCH"),
        (2, "VARIANCE", "0", "MISMATCH", "MATCH"),
        (3, "VARIANCE", "MISMATCH", "MISMATCH", "MISMATCH"),
        (4, "VARIANCE", "MISMATCH", "MISMATCH", "MISMATCH"),
    ]
    assert stacked.count() == 4 + 3 + 3
    flags = cmp.flag_variance(stacked, ["k", "n"])
    assert rows(flags.select("k", "is_variance")) == [
        (1, "no"), (2, "yes"), (3, "yes"), (4, "yes"),
    ]
    summary = agg.variance_counts(flags, ["k"])
    assert rows(summary) == [(1, 1, 0), (2, 1, 1), (3, 1, 1), (4, 1, 1)]


def test_environments(spark):
    test = table(
        spark,
        [("p", 1, 1, 2.0), ("p", 1, 1, 3.0), ("q", 2, 1, 1.0), ("r", 3, 1, 1.0)],
        "prop string, id int, day int, rate double",
    )
    prod = table(
        spark,
        [("p", 1, 1, 5.0), ("q", 2, 1, 4.0), ("r", 3, 1, 9.0)],
        "prop string, stay int, day int, rate double",
    )
    population = table(spark, [(1,), (2,)], "id int")
    run = recon.compare_environments(
        test, prod, ["id", "day"], population, ["id"],
        {"stay": "id", "gone": cmp.NO_MAPPING},
        {"id": "integer", "day": "integer", "rate": "double precision"},
        ["rate"],
    )
    assert rows(run["variance"]) == [(2, 1, "both", "rate", "1.0", "4.0")]
    assert rows(run["matrix"]) == [(1, 0, 0, 0), (2, 0, 1, 1)]


def test_columns(spark):
    test = table(spark, [("id",), ("same",), ("new_col",), ("dw_load",)], "column_name string")
    prod = table(spark, [("stay",), ("same",), ("old_col",), ("dw_load",)], "column_name string")
    mapping = table(spark, [("stay", "id"), ("old_col", cmp.NO_MAPPING)], "old string, new string")
    report = cmp.column_report(test, prod, mapping)
    got = {r["column_name"]: tuple(r)[1:] for r in report.collect()}
    assert got == {
        "id": ("yes", "yes", "no", "stay", None, "stay"),
        "same": ("yes", "yes", "no", None, None, "same"),
        "dw_load": ("yes", "yes", "no", None, None, "dw_load"),
        "new_col": ("yes", "no", "yes", None, "in test, not in prod", None),
        "old_col": ("no", "yes", "yes", None, "in prod, not in test", None),
    }
    assert rows(cmp.select_columns(report)) == [("id", "stay"), ("same", "same")]
    assert rows(cmp.select_columns(report, only_mapped=True)) == [("id", "stay")]
    assert rows(cmp.name_relation(test.toDF("x"))) == [("x", 1)]


def test_align_types(spark):
    df = table(spark, [(1, "x", 1 / 3)])
    got = cmp.align_types(df, {"k": "integer", "s": "date", "x": "double precision"})
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "double"]
    assert got.first()["x"] == 0.3333333333


def test_extracts(spark):
    schema = "g int, s string, v double"
    a = table(spark, [(1, "x", 10.0), (2, "y", None), (3, None, 0.0)], schema)
    b = table(spark, [(1, "X", 15.0), (2, None, 7.0), (4, "w", 1.0)], schema)
    got = cmp.compare_extracts(a, b, ["g"], ["s"], ["v"])
    assert got.columns == [
        "g", "s_select", "s_table", "v_select", "v_table", "s_variance", "v_var %",
    ]
    assert rows(got.select("g", "s_variance", "`v_var %`")) == [
        (1, None, 0.5), (2, "variance", 1.0), (3, None, -1.0), (4, "variance", 1.0),
    ]
    alt = cmp.compare_extracts(a, b, ["g"], ["s"], ["v"], missing_from="neg_to")
    assert rows(alt.select("g", "`v_var %`"))[1] == (2, -7.0)


def test_extract_preconditions(spark):
    a, b = table(spark, []), table(spark, [])
    with pytest.raises(ValueError, match="grain"):
        cmp.check_extracts(a, b.drop("k"), ["k"])
    with pytest.raises(ValueError, match="select lacks"):
        cmp.check_extracts(a.drop("x"), b, ["k"])
    cmp.check_extracts(a, b.drop("x"), ["k"])


def test_spec(spark):
    schema = "schema string, object string, column_name string, data_type string, length int"
    spec = table(
        spark,
        [("s", "o", "a", "varchar", 5), ("s", "o", "b", "timestamp", None),
         ("s", "o", "c", "varchar", 9), ("s", "o", "only_spec", "date", None)],
        schema,
    )
    catalog = table(
        spark,
        [("s", "o", "a", "character varying", 5),
         ("s", "o", "b", "timestamp without time zone", None),
         ("s", "o", "c", "character varying", 10), ("s", "o", "only_target", "date", None)],
        schema,
    )
    got = {
        r["column_name"]: (
            r["object_validation"], r["length_validation"], r["data_type_validation"],
            r["total_validation"],
        )
        for r in cmp.compare_spec(spec, catalog).collect()
    }
    assert got == {
        "a": ("good", "good", "good", "good"),
        "b": ("good", "good", "good", "good"),
        "c": ("good", "bad", "good", "bad"),
        "only_spec": ("bad", "good", "bad", "bad"),
        "only_target": ("bad", "good", "bad", "bad"),
    }
    from pyspark.sql import functions as F

    with_new = cmp.compare_spec(spec.withColumn("net_new", F.lit("x")), catalog)
    assert "net_new" in with_new.columns


def test_variance_matrix(spark):
    cells = table(
        spark,
        [(1, "a", "1", "2"), (1, "a", "1", "3"), (2, "b", "1", "2")],
        "k int, column_name string, test_value string, prod_value string",
    )
    assert rows(agg.variance_matrix(cells, ["k"], ["a", "b"])) == [(1, 2, 0, 2), (2, 0, 1, 1)]
    assert rows(agg.variance_detail(cells, ["k"], "b")) == [(2, "1", "2")]


def test_wide_form_keeps_missing_keys(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 9), (2, 2)], "k int, v int")
    assert rows(cmp.compare_wide(a, b, ["k"], ["v"])) == [(None, 1, 9)]


@pytest.mark.parametrize("swap", [False, True])
def test_types_are_compared_alike_both_ways(spark, swap):
    a = spark.createDataFrame([(1, 3, "5", 7)], "k int, n int, t string, f int")
    b = spark.createDataFrame([(1, 3.00000000000001, 5, 7.5)], "k int, n double, t int, f double")
    a, b = (b, a) if swap else (a, b)
    assert [r["column_name"] for r in cmp.compare_cells(a, b, ["k"]).collect()] == ["f"]
    assert cmp.compare_wide(a, b, ["k"], ["n", "t"]).count() == 0
    stacked = cmp.stack_sides(a, b, ["k"]).filter("row_source = 'VARIANCE'").first()
    assert (stacked["n"], stacked["t"]) == ("0", "MATCH")


def test_values_that_do_not_parse(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "12")], "k int, v string")
    types = {"k": "integer", "v": "integer"}
    assert rows(cmp.align_types(df, types)) == [(1, None), (2, 12)]
    assert rows(cmp.align_types(df, types, as_text=["v"])) == [(1, "abc"), (2, "12")]


def test_codes_are_no_numbers(spark):
    a = spark.createDataFrame([("g", 1, "12D"), ("g", 2, "1e2")], "g string, n int, v string")
    b = spark.createDataFrame([("g", 1, "12F"), ("g", 2, "100")], "g string, n int, v string")
    cells = cmp.compare_tidy(a, b, ["g"], ["n"]).filter("column_name = 'v'")
    assert {r["test_value"]: r["match"] for r in cells.collect()} == {"12D": "N", "1e2": "Y"}


def test_missing_keys_of_a_population(spark):
    test = table(spark, [(None, 1, 5.0), (1, 1, 1.0), (2, 1, 1.0)], "id int, day int, rate double")
    prod = table(spark, [(None, 1, 6.0), (1, 1, 1.0), (2, 1, 9.0)], "id int, day int, rate double")
    population = table(spark, [(None,), (1,)], "id int")
    types = {"id": "integer", "day": "integer", "rate": "double precision"}
    run = recon.compare_environments(test, prod, ["id", "day"], population, ["id"], {}, types)
    assert rows(run["variance"]) == [(None, 1, "both", "rate", "5.0", "6.0")]
    assert rows(run["matrix"]) == [(1, 0, 0), (None, 1, 1)]
    summary = recon.positional_run(test, prod, population, ["id"], ["day"])["summary"]
    assert rows(summary) == [(1, "OK", 0), (None, "OK", 1)]


def test_repeated_keys_are_met_without_a_check(spark):
    df = table(spark, [(1, "a", 1.0), (1, "b", 1.0)] + [(i, "x", 0.0) for i in range(2, 50)])
    other = table(spark, [(i, "y", 0.0) for i in range(1, 50)])
    for run in (
        lambda: cmp.compare_cells(df, other, ["k"], check_keys=False),
        lambda: cmp.stack_sides(other, df, ["k"], check_keys=False),
        lambda: cmp.compare_wide(df, df, ["k"], ["s"], check_keys=False),
    ):
        with pytest.raises(Exception, match="no key"):
            run().collect()


def test_a_hot_repeated_key_is_counted_not_paired(spark):
    hot = spark.range(20000).selectExpr("cast(if(id < 15000, null, id) as int) as k", "'a' as s", "1.0D as x")
    with pytest.raises(ValueError, match="no key"):
        cmp.compare_cells(hot, hot, ["k"])


def test_what_cannot_be_compared_is_noted(spark):
    test = table(spark, [("1", 1, "5"), ("2", 1, "five"), ("2", 1, "4"), ("x", 1, "1"), ("y", 1, "1")], "id string, day int, rate string")
    prod = table(spark, [(1, "1", "5.0"), (2, "1", "?"), (3, "one", "1")], "id int, day string, rate string")
    population = table(spark, [(1,), (2,), (3,), (None,)], "id int")
    types = {"id": "integer", "day": "integer", "rate": "double precision"}
    run = recon.compare_environments(test, prod, ["id", "day"], population, ["id"], {}, types, ["rate"])
    assert rows(run["variance"]) == [(2, 1, "both", "rate", "4.0", "?")]
    assert rows(run["matrix"]) == sorted([(1, 0, 0), (2, 1, 1), (3, 0, 0), (None, 0, 0)], key=repr)
    assert rows(run["notes"]) == sorted(
        [
            (2, 1, "test", "rate", "five", cmp.BAD_VALUE),
            (2, 1, "prod", "rate", "?", cmp.BAD_VALUE),
            (None, 1, "test", "id", "x", cmp.BAD_KEY),
            (None, 1, "test", "id", "y", cmp.BAD_KEY),
            (3, None, "prod", "day", "one", cmp.BAD_KEY),
            (3, None, "test", None, None, cmp.NO_ROWS),
            (None, None, "test", None, None, cmp.NO_ROWS),
            (3, None, "prod", None, None, cmp.NO_ROWS),
            (None, None, "prod", None, None, cmp.NO_ROWS),
        ],
        key=repr,
    )
    with pytest.raises(ValueError, match="not in both"):
        recon.compare_environments(test, prod, ["id", "gone"], population, ["id"], {}, types)
    mapped = recon.compare_environments(
        test.withColumn("b", F.lit("u")), prod.withColumnRenamed("rate", "r").withColumn("b", F.lit("v")),
        ["id", "day"], population, ["id"], {"r": "rate"}, types, ["rate", "b"], only_mapped=True,
    )
    assert {r["column_name"] for r in mapped["variance"].collect()} == {"rate"}
