"""Tables by name, queries with parameters, reports of several tables, other formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgeframe.functions.dates import file_name_attributes, stay_file_keys
from lodgeframe.functions.types import warehouse_type
from lodgeframe.operators.shape import lower_names, quoted
from lodgeframe.sources import csv, records


def table(
    spark: SparkSession,
    name: str,
    folder: str | None = None,
    jdbc: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table by name, with lower-case column names.

    From the catalog; from parquet files below ``folder``; or from a database,
    given the options of Spark's JDBC source.
    """
    if jdbc is not None:
        df = spark.read.format("jdbc").options(**{**jdbc, "dbtable": name}).load()
    elif folder is not None:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
    else:
        df = spark.table(name)
    return lower_names(df)


def parameter_query(
    spark: SparkSession, sql: str, values: Mapping[str, object], **frames: DataFrame
) -> DataFrame:
    """A statement with named markers (``:name``), and tables given as frames (``{name}``)."""
    return spark.sql(sql, args=dict(values), **frames)


def schema_relation(df: DataFrame, schema: str, name: str) -> DataFrame:
    """A table's schema as rows: schema, object, column_name, data_type, length, ordinal."""
    fields = "schema string, object string, column_name string, data_type string, "
    rows = [
        (schema, name, f.name, warehouse_type(f.dataType), getattr(f.dataType, "length", None), i)
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(rows, fields + "length int, ordinal int")


def observed_schema(df: DataFrame, schema: str, name: str) -> DataFrame:
    """The same, with the length of text columns as found in the data."""
    rows = [
        F.struct(
            F.lit(schema).alias("schema"),
            F.lit(name).alias("object"),
            F.lit(f.name).alias("column_name"),
            F.lit(warehouse_type(f.dataType)).alias("data_type"),
            (
                F.max(F.length(quoted(f.name)))
                if isinstance(f.dataType, T.StringType)
                else F.lit(None).cast("int")
            ).alias("length"),
            F.lit(i).alias("ordinal"),
            F.count(quoted(f.name)).alias("value_count"),
        )
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def read_files(spark: SparkSession, folder: str, pattern: str = "*", fmt: str = "csv", **options):
    """Files of a folder picked by a name pattern, with the name of each row's file.

    Columns go by their names: CSV files may have them in any order, and a column that a file lacks is missing in its
    rows. Their headers come out of one job, however many files there are.
    """
    options = {**csv.DIALECT, **options} if fmt == "csv" else options
    if fmt == "csv" and options["header"]:
        lines = records.read_lines(spark, folder, pattern, str(options["encoding"]))
        return records.parsed(lines, options, one_header=False)
    reader = spark.read.format(fmt).option("recursiveFileLookup", True).options(**options)
    found = reader.option("pathGlobFilter", pattern).load(folder)
    return found.withColumn("file_name", F.col("_metadata.file_name"))


def with_file_attributes(df: DataFrame, name: str = "file_name") -> DataFrame:
    return df.withColumns(file_name_attributes(F.col(name)))


def with_stay_keys(df: DataFrame, name: str = "file_name") -> DataFrame:
    return df.withColumns(stay_file_keys(F.col(name)))


def write_report(sheets: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Overwrite a report: one folder per table."""
    for name, df in sheets.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{folder}/{name}")


def convert(
    spark: SparkSession, source: str, source_format: str, target: str, target_format: str, **options
) -> None:
    """Rewrite a table in another format; CSV as csv.scan_csv() and csv.write_csv() do unless options differ."""
    options = {**csv.DIALECT, **options} if source_format == "csv" else options
    if source_format == "csv" and options["header"]:
        lines = records.read_lines(spark, source, encoding=str(options["encoding"]))
        df = records.parsed(lines, options, one_header=True).drop("file_name")
    else:
        df = spark.read.format(source_format).options(**options).load(source)
    if target_format == "csv":
        csv.write_csv(df, target)
    else:
        df.write.mode("overwrite").format(target_format).save(target)
