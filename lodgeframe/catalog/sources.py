"""Queries of sources and sinks: tables written to files and read back."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from lodgeframe import views
from lodgeframe.catalog.profile import NOTES, SHAPES, notes
from lodgeframe.catalog.registry import query
from lodgeframe.operators.aggregates import distinct_values
from lodgeframe.operators.profile import profile_table
from lodgeframe.sources import csv, tables
from lodgeframe.sources.scratch import new_path

_TEXT_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@lru_cache(maxsize=64)
def files(spark, sf, kind: str) -> str:
    """Folder of CSV files written from a table, once per session and kind."""
    path = new_path(spark, f"csv-{kind}")
    if kind == "notes":
        csv.write_csv(notes(spark, sf).drop("nothing"), path)
    elif kind == "part":
        csv.write_csv(views.read(spark, sf, "part"), path)
    elif kind == "orders":
        orders = views.read(spark, sf, "orders").select(*_TEXT_COLUMNS)
        csv.write_csv(orders.withColumn("o_orderdate", F.to_date("o_orderdate")), path)
    elif kind == "documents":
        by_lang = views.read(spark, sf, "documents").select(
            "doc_id", "text", "lang", "source", F.col("lang").alias("lang_folder")
        )
        csv.write_csv(by_lang, path, partition_by=["lang_folder"])
        # files of another kind, which are left out by their names
        by_lang.write.mode("append").json(path)
    return path


@query(
    "src_csv_scan",
    f"""WITH {NOTES} SELECT CAST(note_id AS VARCHAR) AS note_id, note, note IS NULL AS is_missing
    FROM notes""",
)
def src_csv_scan(spark, sf):
    return csv.scan_csv(spark, files(spark, sf, "notes")).select(
        "note_id", "note", F.col("note").isNull().alias("is_missing")
    )


def _types_sql(types: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS value_count FROM {table}"
        for c, t in types.items()
    )


def _typed_columns(spark, sf, kind, overrides=None):
    df = csv.read_csv(spark, files(spark, sf, kind), overrides)
    counts = profile_table(df, ["row_count", "null_count"])
    return counts.select(
        F.col("field").alias("column_name"),
        "data_type",
        (F.col("row_count") - F.col("null_count")).alias("value_count"),
    )


@query("src_infer_types", _types_sql(SHAPES["part"], "part"))
def src_infer_types(spark, sf):
    return _typed_columns(spark, sf, "part")


@query(
    "src_infer_dates",
    _types_sql(
        dict(zip(_TEXT_COLUMNS, ["Int64", "Int64", "String", "Float64", "String", "String"])), "orders"
    ),
)
def src_infer_dates(spark, sf):
    return _typed_columns(spark, sf, "orders")


@query("src_schema_override", _types_sql({**SHAPES["part"], "p_size": "String"}, "part"))
def src_schema_override(spark, sf):
    return _typed_columns(spark, sf, "part", {"p_size": "String"})


@query("src_extract_csv", "SELECT * FROM part")
def src_extract_csv(spark, sf):
    schema = (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    )
    return csv.read_extract(spark, files(spark, sf, "part"), schema)


@query(
    "src_multi_file",
    "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, CAST(sum(length(text)) AS BIGINT) AS chars, "
    "true AS named FROM documents GROUP BY lang",
)
def src_multi_file(spark, sf):
    df = tables.read_files(spark, files(spark, sf, "documents"), "part-*.csv")
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("source").alias("sources"),
        F.sum(F.length("text")).alias("chars"),
        F.bool_and(F.col("file_name").rlike("^part-.*csv$")).alias("named"),
    )


@query("agg_unique_over_files", "SELECT DISTINCT source FROM documents")
def agg_unique_over_files(spark, sf):
    return distinct_values(
        tables.read_files(spark, files(spark, sf, "documents"), "*.csv"), "source"
    )


# File names made from the orders: digits or a spelled date, corrections, no underscore.
FILE_NAMES = """
named AS (SELECT o_orderkey AS id, CASE o_orderkey % 4
    WHEN 0 THEN 'Users_' || strftime(o_orderdate, '%Y%m%d') || '_chain.csv'
    WHEN 1 THEN 'Parity_' || strftime(o_orderdate, '%B') || '-' || day(o_orderdate) || 'th-'
      || year(o_orderdate) || '_correction_file.csv'
    WHEN 2 THEN 'plain' || o_orderkey || '.csv'
    ELSE 'Extranet_unknown_x.csv' END AS file_name, o_orderdate FROM orders)"""


def file_names(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    spelled = F.concat(
        F.lit("Parity_"), F.date_format(day, "MMMM-d"), F.lit("th-"), F.date_format(day, "yyyy"),
        F.lit("_correction_file.csv"),
    )
    digits = F.concat(F.lit("Users_"), F.date_format(day, "yyyyMMdd"), F.lit("_chain.csv"))
    name = (
        F.when(key % 4 == 0, digits)
        .when(key % 4 == 1, spelled)
        .when(key % 4 == 2, F.concat(F.lit("plain"), key.cast("string"), F.lit(".csv")))
        .otherwise(F.lit("Extranet_unknown_x.csv"))
    )
    return views.read(spark, sf, "orders").select(key.alias("id"), name.alias("file_name"))


@query(
    "src_file_attrs",
    f"""WITH {FILE_NAMES} SELECT id, file_name,
      CASE id % 4 WHEN 0 THEN 'Users' WHEN 1 THEN 'Parity' WHEN 3 THEN 'Extranet' END
        AS data_subject,
      CASE WHEN id % 4 < 2 THEN strftime(o_orderdate, '%Y%m%d') END AS file_date,
      CASE id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'correction' WHEN 3 THEN 'daily' END
        AS file_type
    FROM named""",
)
def src_file_attrs(spark, sf):
    return tables.with_file_attributes(file_names(spark, sf))


@query(
    "src_file_keys",
    """SELECT file_name, CASE WHEN stay_id % 3 <> 0 THEN prop_cd END AS prop_cd,
      CASE WHEN stay_id % 3 <> 0 THEN CAST(stay_id AS VARCHAR) ELSE file_name END AS stay_id
    FROM (SELECT stay_id, prop_cd, CASE WHEN stay_id % 3 <> 0
        THEN 'check (' || prop_cd || ' stay_id ' || stay_id || ').csv'
        ELSE 'summary ' || stay_id || '.csv' END AS file_name FROM checkout_detail)""",
)
def src_file_keys(spark, sf):
    key = F.col("stay_id")
    name = F.when(
        key % 3 != 0,
        F.concat(F.lit("check ("), "prop_cd", F.lit(" stay_id "), key.cast("string"), F.lit(").csv")),
    ).otherwise(F.concat(F.lit("summary "), key.cast("string"), F.lit(".csv")))
    detail = views.checkout_detail(spark, sf).select(name.alias("file_name"))
    return tables.with_stay_keys(detail)


@query(
    "src_param_query",
    """SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
      AND o_orderpriority = '5-LOW'""",
)
def src_param_query(spark, sf):
    return tables.parameter_query(
        spark,
        """SELECT o_orderkey, o_totalprice FROM {orders}
        WHERE o_orderdate BETWEEN CAST(:start AS DATE) AND CAST(:end AS DATE)
          AND o_orderpriority = :priority""",
        {"start": "1997-01-01", "end": "1997-12-31", "priority": "5-LOW"},
        orders=views.read(spark, sf, "orders"),
    )


_LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "integer",
    "l_quantity": "double precision", "l_extendedprice": "double precision", "l_discount": "double precision",
    "l_tax": "double precision", "l_returnflag": "character varying", "l_linestatus": "character varying",
    "l_shipdate": "timestamp without time zone",
}


@query(
    "src_schema_relation",
    " UNION ALL ".join(
        f"SELECT 'sales' AS schema, 'lineitem' AS object, '{c}' AS column_name, "
        f"'{t}' AS data_type, {i} AS ordinal, "
        + (f"CAST(max(length({c})) AS INTEGER)" if "char" in t else "NULL")
        + f" AS length, count({c}) AS value_count FROM lineitem"
        for i, (c, t) in enumerate(_LINE_TYPES.items(), start=1)
    ),
)
def src_schema_relation(spark, sf):
    return tables.observed_schema(views.read(spark, sf, "lineitem"), "sales", "lineitem")


@query(
    "sink_csv_round_trip",
    f"""WITH {NOTES} SELECT note_id, note FROM notes""",
)
def sink_csv_round_trip(spark, sf):
    first = csv.read_csv(spark, files(spark, sf, "notes"), {"note": "String"})
    path = new_path(spark, "csv-again")
    csv.write_csv(first, path)
    return csv.read_csv(spark, path, {"note": "String"})


@query(
    "sink_report",
    "SELECT 'rows' AS sheet, count(*) AS n FROM orders "
    "UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders",
)
def sink_report(spark, sf):
    orders = views.read(spark, sf, "orders")
    folder = new_path(spark, "report")
    tables.write_report({"rows": orders, "customers": orders.select("o_custkey").distinct()}, folder)
    sheets = [
        spark.read.parquet(f"{folder}/{name}").agg(
            F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("n")
        )
        for name in ("rows", "customers")
    ]
    return sheets[0].unionByName(sheets[1])


@query("sink_convert", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part")
def sink_convert(spark, sf):
    path = new_path(spark, "json")
    tables.convert(spark, files(spark, sf, "part"), "csv", path, "json", header=True)
    return spark.read.schema("p_partkey string, p_name string").json(path)
