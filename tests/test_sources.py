from types import SimpleNamespace

import pytest
from conftest import rows

from lodgeframe.functions.types import warehouse_type
from lodgeframe.sources import csv, scratch, tables


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf8")
    return str(path)


def test_blank_and_missing_fields_differ(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b,c", "1,,x", '2,"",y', '3," s ","a ""q"" b"')
    assert rows(csv.scan_csv(spark, path)) == [
        ("1", None, "x"), ("2", "", "y"), ("3", " s ", 'a "q" b'),
    ]


def test_line_breaks_inside_fields(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b", '1,"x', 'y"')
    assert rows(csv.scan_csv(spark, path, multi_line=True)) == [("1", "x\ny")]


def test_types(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "i,f,d,z,m,b,e,big,sci",
        "1,1.5,2024-01-01,007,1,true,,99999999999999999999,1e3",
        "-2,2,2024-01-02,8,x,false,,1,.5",
    )
    text = csv.scan_csv(spark, path)
    types = csv.infer_types(text)
    assert types == {
        "i": "Int64", "f": "Float64", "d": "String", "z": "Int64", "m": "String", "b": "Boolean",
        "e": "String", "big": "Float64", "sci": "Float64",
    }
    typed = csv.read_csv(spark, path, {"z": "String"})
    assert dict(typed.dtypes)["i"] == "bigint" and dict(typed.dtypes)["z"] == "string"
    assert [r["z"] for r in typed.collect()] == ["007", "8"]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, ""), (2, None), (3, ' a,"b" '), (4, "é")], "i bigint, s string"
    )
    csv.write_csv(df, str(tmp_path / "out"))
    assert rows(csv.read_csv(spark, str(tmp_path / "out"))) == rows(df)


def test_files_by_name(spark, tmp_path):
    for name, value in [("Users_20240101_x.csv", 1), ("Users_20240102_x.csv", 2), ("Other.csv", 3)]:
        write(tmp_path / name, "v", str(value))
    df = tables.with_file_attributes(tables.read_files(spark, str(tmp_path), "Users*"))
    assert rows(df.select("v", "file_date", "data_subject")) == [
        ("1", "20240101", "Users"), ("2", "20240102", "Users"),
    ]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "ID int, Name string")
    df.createOrReplaceTempView("some_table")
    assert tables.table(spark, "some_table").columns == ["id", "name"]
    df.write.parquet(str(tmp_path / "other.parquet"))
    assert tables.table(spark, "other", str(tmp_path)).collect()[0]["name"] == "x"


def test_parameters_are_values_not_text(spark):
    df = spark.createDataFrame([("a",), ("b' OR '1'='1",)], "s string")
    sql = "SELECT * FROM {t} WHERE s = :s"
    assert rows(tables.parameter_query(spark, sql, {"s": "b' OR '1'='1"}, t=df)) == [
        ("b' OR '1'='1",)
    ]


def test_schema_relation(spark):
    df = spark.createDataFrame([(1, "abc", 1.0, None)], "i int, s string, x double, b boolean")
    got = rows(tables.schema_relation(df, "sch", "obj"), "ordinal")
    assert [r[2:] for r in got] == [
        ("i", "integer", None, 1), ("s", "character varying", None, 2),
        ("x", "double precision", None, 3), ("b", "boolean", None, 4),
    ]
    observed = rows(tables.observed_schema(df, "sch", "obj"), "ordinal")
    assert observed[1] == ("sch", "obj", "s", "character varying", 3, 2, 1)
    assert warehouse_type(spark.range(1).schema[0].dataType) == "bigint"


def test_report_and_conversion(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "i int, s string")
    tables.write_report({"one": df, "two": df.limit(0)}, str(tmp_path / "report"))
    tables.write_report({"one": df}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/one")).count() == 1
    tables.convert(
        spark, str(tmp_path / "report/one"), "parquet", str(tmp_path / "csv"), "csv"
    )
    assert rows(csv.read_csv(spark, str(tmp_path / "csv"))) == [(1, "x")]


class Session:
    """A session with the given checkpoint folder and master."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master)


def test_shared_folder_comes_from_the_session(spark):
    assert scratch.shared_folder(Session("hdfs:///shared", "yarn")) == "hdfs:///shared"
    assert scratch.shared_folder(Session("/x", "local[8]")) == "/x"
    local = scratch.shared_folder(Session(None, "local[8]"))
    assert local == scratch.shared_folder(Session(None, "local[8]"))
    with pytest.raises(ValueError):
        scratch.shared_folder(Session(None, "yarn"))


def test_intermediate_tables(spark):
    df = spark.range(3)
    assert rows(scratch.written(df, "t")) == rows(scratch.checkpointed(df)) == rows(df)


@pytest.mark.parametrize("fmt", ["json", "orc"])
def test_other_formats(spark, tmp_path, fmt):
    spark.createDataFrame([(1, "x")], "i int, s string").write.format(fmt).save(str(tmp_path / "a"))
    tables.convert(spark, str(tmp_path / "a"), fmt, str(tmp_path / "b"), "parquet")
    assert rows(spark.read.parquet(str(tmp_path / "b")).select("i", "s")) == [(1, "x")]


def test_line_breaks_are_safe_by_default(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b", '1,"line1', 'line2, x"', '2,"say ""hi"", you"')
    assert rows(csv.scan_csv(spark, path)) == [("1", "line1\nline2, x"), ("2", 'say "hi", you')]


def test_columns_go_by_their_header(spark, tmp_path):
    path = write(tmp_path / "a.csv", "nights,prop,more", '7,"P ""7""",x', 'bad,"",y')
    got = csv.read_extract(spark, path, "prop string, nights int")
    assert rows(got) == [("", None), ('P "7"', 7)]
    write(tmp_path / "b.csv", "prop,nights", "P8,8")
    with pytest.raises(Exception, match="(?i)header|schema"):
        csv.scan_csv(spark, [path, str(tmp_path / "b.csv")]).collect()
    both = tables.read_files(spark, str(tmp_path)).select("file_name", "prop", "nights", "more")
    assert rows(both) == [
        ("a.csv", "", "bad", "y"), ("a.csv", 'P "7"', "7", "x"), ("b.csv", "P8", "8", None),
    ]


def test_conversion_keeps_quotes_and_blanks(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b", '1,""', '2,"x ""y"", z"', "3,")
    tables.convert(spark, path, "csv", str(tmp_path / "p"), "parquet")
    want = [("1", ""), ("2", 'x "y", z'), ("3", None)]
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == want
    tables.convert(spark, str(tmp_path / "p"), "parquet", str(tmp_path / "c"), "csv")
    assert rows(csv.scan_csv(spark, str(tmp_path / "c"))) == want
