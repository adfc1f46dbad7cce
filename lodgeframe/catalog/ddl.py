"""Queries of DDL types, dictionaries and characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgeframe import views
from lodgeframe.catalog.profile import SHAPES, profile_sql, profiled
from lodgeframe.catalog.registry import query
from lodgeframe.functions import types as ft
from lodgeframe.operators import ddl
from lodgeframe.operators.profile import merge_profiles, profile_table
from lodgeframe.operators.sets import union_all

# Profiles of three tables, with a target type for some of their fields.
_LENGTHS = ["max_length_of_characters", "max_octet_length"]
_TABLES = ["documents", "part", "events"]
TARGETS = """
targets AS (SELECT * FROM (VALUES ('lang', 'date', NULL), ('source', 'date', 'parse'),
  ('p_size', 'float', NULL), ('p_brand', 'string', NULL), ('p_retailprice', 'string', NULL))
  AS t(target_field, data_type_new, transform_needed))"""
TYPED = f"""{TARGETS},
profiles AS ({" UNION ALL ".join(profile_sql(t, _LENGTHS) for t in _TABLES)}),
typed AS (
  SELECT p.*, data_type_new, transform_needed,
    CASE WHEN data_type LIKE '%Int%' THEN 'integer' WHEN data_type LIKE '%Float%' THEN 'float'
      WHEN data_type = 'String' AND data_type_new = 'date' AND transform_needed IS NULL THEN 'date'
      ELSE 'string' END AS source_data_type
  FROM profiles p LEFT JOIN targets ON field = target_field)"""


def target_sql(length: str) -> str:
    return f"""CASE WHEN source_data_type <> 'string' THEN coalesce(data_type_new, source_data_type)
      WHEN data_type_new IS NULL OR data_type_new = 'string'
        THEN 'varchar(' || CAST({length} AS BIGINT) || ')'
      ELSE data_type_new END"""


_LENGTH = "greatest(max_length_of_characters, max_octet_length)"


def typed(spark, sf):
    targets = spark.sql(
        """SELECT * FROM VALUES ('lang', 'date', NULL), ('source', 'date', 'parse'),
        ('p_size', 'float', NULL), ('p_brand', 'string', NULL), ('p_retailprice', 'string', NULL)
        AS t(field, data_type_new, transform_needed)"""
    )
    profiles = union_all([profile_table(profiled(spark, sf, t), _LENGTHS) for t in _TABLES])
    source = ft.source_type(F.col("data_type"), F.col("data_type_new"), F.col("transform_needed"))
    return profiles.join(targets, "field", "left").withColumn("source_data_type", source)


@query("ddl_source_type", f"WITH {TYPED} SELECT field, data_type, source_data_type FROM typed")
def ddl_source_type(spark, sf):
    return typed(spark, sf).select("field", "data_type", "source_data_type")


def _target(headroom=None):
    return ft.target_type(
        F.col("source_data_type"),
        F.col("data_type_new"),
        F.col("max_length_of_characters"),
        F.col("max_octet_length"),
        headroom,
    ).alias("target_data_type")


@query(
    "ddl_target_type",
    f"WITH {TYPED} SELECT field, {target_sql(_LENGTH)} AS target_data_type FROM typed",
)
def ddl_target_type(spark, sf):
    return typed(spark, sf).select("field", _target())


@query(
    "ddl_target_type_buffer",
    f"""WITH {TYPED} SELECT field,
      {target_sql(f"ceil({_LENGTH} * CAST(1.2 AS DOUBLE))")} AS target_data_type FROM typed""",
)
def ddl_target_type_buffer(spark, sf):
    return typed(spark, sf).select("field", _target(ddl.BUFFER))


# A data dictionary with an entry per part, and types that overrule some of them.
DICTIONARY = """
dictionary AS (
  SELECT p_partkey AS item, p_brand AS filename, p_name || ' ' || p_partkey AS field_name,
    CASE p_partkey % 6 WHEN 0 THEN 'Double' WHEN 1 THEN 'float' WHEN 2 THEN 'INT'
      WHEN 3 THEN 'string' WHEN 4 THEN 'Date' ELSE 'String' END AS data_type,
    CASE WHEN p_size % 4 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS max_length,
    CASE p_partkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'n'
      WHEN 2 THEN 'Y (only scans that have a reshop)'
      WHEN 3 THEN 'Y (except for clickbait lines - Null)' ELSE 'maybe' END AS mandatory,
    p_type AS example, p_name AS description
  FROM part),
processed AS (
  SELECT *, CASE lower(data_type) WHEN 'double' THEN 'double precision'
      WHEN 'float' THEN 'double precision' WHEN 'int' THEN 'integer' WHEN 'string' THEN 'varchar'
      ELSE lower(data_type) END AS normalized,
    CASE WHEN item % 10 = 0 THEN 'varchar' END AS overwrite,
    coalesce(overwrite, normalized) AS new_type,
    CASE WHEN upper(mandatory) = 'Y' THEN 'yes' WHEN upper(mandatory) = 'N' THEN 'no'
      WHEN mandatory = 'Y (only scans that have a reshop)'
        THEN 'yes partial, if scans have a reshop'
      WHEN mandatory = 'Y (except for clickbait lines - Null)'
        THEN 'yes partial, if clickbait lines are not null' END AS required
  FROM dictionary)"""


def dictionary(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*[F.lit(x) for x in ("Double", "float", "INT", "string", "Date", "String")])
    marks = F.array(
        F.lit("Y"), F.lit("n"), *[F.lit(x) for x in ft.PARTLY_REQUIRED], F.lit("maybe")
    )
    return views.read(spark, sf, "part").select(
        key.alias("Item No."),
        F.col("p_brand").alias("Filename"),
        F.concat_ws(" ", "p_name", key.cast("string")).alias("Field Name"),
        F.get(kinds, (key % 6).cast("int")).alias("Data Type"),
        F.when(size % 4 == 0, F.lit("n/a"))
        .otherwise(size.cast("string"))
        .alias("Max Length (if String)"),
        F.get(marks, (key % 5).cast("int")).alias("Mandatory (Y/N) for Business Reporting"),
        F.col("p_type").alias("Example"),
        F.col("p_name").alias("Description"),
    )


def processed(spark, sf):
    entries = dictionary(spark, sf)
    overwrite = entries.filter(F.col("`Item No.`") % 10 == 0).select(
        "Filename", "`Field Name`", F.lit("varchar").alias("data_type_overwrite")
    )
    return ddl.process_dictionary(entries, overwrite)


def _dict_query(name: str, sql: str, columns: dict[str, str]):
    @query(name, f"WITH {DICTIONARY} SELECT item, {sql} FROM processed")
    def run(spark, sf):
        done = processed(spark, sf)
        return done.select(
            F.col("`Item No.`").alias("item"), *[F.col(c).alias(a) for c, a in columns.items()]
        )


_dict_query("dict_normalize_type", "normalized", {"data_type_normalized": "normalized"})
_dict_query(
    "dict_overwrite_type",
    "overwrite, new_type",
    {"data_type_overwrite": "overwrite", "data_type_new": "new_type"},
)
_dict_query(
    "dict_char_max_length",
    "CASE WHEN new_type = 'varchar' THEN TRY_CAST(max_length AS BIGINT) END AS char_max_length",
    {"char_max_length": "char_max_length"},
)
_dict_query("dict_required_flag", "required", {"is_required_for_reporting": "required"})


@query(
    "ddl_is_required_field",
    f"""WITH {DICTIONARY} SELECT p_partkey,
      CASE WHEN item IS NOT NULL THEN 'yes' ELSE 'no' END AS is_required_field
    FROM part LEFT JOIN processed ON item = p_partkey + 100""",
)
def ddl_is_required_field(spark, sf):
    entries = processed(spark, sf).select(
        (F.col("`Item No.`") - 100).alias("p_partkey"), "data_type_new"
    )
    return (
        views.read(spark, sf, "part")
        .select("p_partkey")
        .join(entries, "p_partkey", "left")
        .select(
            "p_partkey", ft.is_required_field(F.col("data_type_new")).alias("is_required_field")
        )
    )


@query(
    "ddl_is_required_reporting",
    f"""WITH {DICTIONARY} SELECT item,
      CASE WHEN lower(required) LIKE '%yes%' THEN 'yes' ELSE 'no' END AS is_required
    FROM processed""",
)
def ddl_is_required_reporting(spark, sf):
    required = ft.is_required_for_business_reporting(F.col("is_required_for_reporting"))
    return processed(spark, sf).select(
        F.col("`Item No.`").alias("item"), required.alias("is_required")
    )


# The profile of the parts, described by a dictionary cut from the parts themselves: the
# entry with the highest number of each type describes the field of that name.
_FIELDS = list(SHAPES["part"])
_FIELD_CASE = " ".join(f"WHEN {i} THEN upper('{f}')" for i, f in enumerate(_FIELDS[:4]))
_FINAL_METRICS = ["row_count", *_LENGTHS]


@query(
    "ddl_final_profile",
    f"""WITH {DICTIONARY}, {TARGETS},
    entries AS (
      SELECT lower(CASE item % 4 {_FIELD_CASE} END) AS dict_field,
        arg_max(data_type, item) AS dict_type, arg_max(description, item) AS dict_description,
        arg_max(CASE WHEN new_type = 'varchar' THEN coalesce(TRY_CAST(max_length AS BIGINT), -1)
          ELSE -1 END, item) AS dict_length,
        arg_max(coalesce(required, ''), item) AS dict_required
      FROM processed WHERE filename = 'Brand#1' GROUP BY 1),
    profiles AS ({profile_sql("part", _FINAL_METRICS)}),
    typed AS (
      SELECT p.*, data_type_new, transform_needed, e.*,
        CASE WHEN data_type LIKE '%Int%' THEN 'integer' WHEN data_type LIKE '%Float%' THEN 'float'
          ELSE 'string' END AS source_data_type
      FROM profiles p LEFT JOIN targets ON field = target_field
        LEFT JOIN entries e ON lower(field) = dict_field)
    SELECT field, 1::BIGINT AS file_count, row_count, source_data_type,
      {target_sql(_LENGTH)} AS target_data_type,
      {target_sql(f"ceil({_LENGTH} * CAST(1.2 AS DOUBLE))")} AS target_data_type_with_20_pct_buffer,
      transform_needed, lower(dict_type) AS dict_type, lower(dict_description) AS dict_description,
      nullif(dict_length, -1) AS dict_length, lower(nullif(dict_required, '')) AS dict_required,
      CASE WHEN dict_type IS NULL THEN 'no' ELSE 'yes' END AS is_required_field,
      CASE WHEN dict_required LIKE '%yes%' THEN 'yes' ELSE 'no' END
        AS is_required_for_business_reporting
    FROM typed""",
)
def ddl_final_profile(spark, sf):
    names = F.array(*[F.lit(f.upper()) for f in _FIELDS[:4]])
    entries = processed(spark, sf).withColumn(
        "Field Name", F.get(names, (F.col("`Item No.`") % 4).cast("int"))
    )
    targets = spark.sql(
        """SELECT 'Brand#1' AS data_subject, *, CAST(NULL AS STRING) AS source_format
        FROM VALUES ('p_size', 'float', NULL), ('p_brand', 'string', NULL),
        ('p_retailprice', 'string', NULL) AS t(field, data_type_new, transform_needed)"""
    ).withColumn("transform_needed", F.col("transform_needed").cast("string"))
    merged = merge_profiles([profile_table(profiled(spark, sf, "part"))])
    final = ddl.final_profile(merged, entries, targets, "Brand#1")
    return final.select(
        "field",
        "file_count",
        "row_count",
        "source_data_type",
        "target_data_type",
        "target_data_type_with_20_pct_buffer",
        "transform_needed",
        F.col("data dict data_type").alias("dict_type"),
        F.col("data dict description").alias("dict_description"),
        F.col("data dict char_max_length").alias("dict_length"),
        F.col("data dict is_required_for_reporting").alias("dict_required"),
        "is_required_field",
        "is_required_for_business_reporting",
    )


@query(
    "txt_by_octet_length",
    "SELECT DISTINCT text FROM documents WHERE strlen(text) BETWEEN 100 AND 100 "
    "UNION SELECT DISTINCT p_name FROM part WHERE strlen(p_name) = 10",
)
def txt_by_octet_length(spark, sf):
    texts = ddl.values_of_octet_length(views.read(spark, sf, "documents"), "text", 100)
    names = ddl.values_of_octet_length(views.read(spark, sf, "part"), "p_name", 10)
    return texts.union(names).distinct()


@query(
    "txt_non_ascii_values",
    "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]')",
)
def txt_non_ascii_values(spark, sf):
    return ddl.non_ascii_values(views.read(spark, sf, "documents"), "text").select("doc_id", "lang")


@query(
    "txt_non_ascii_chars",
    """SELECT doc_id, c AS "char", hex(encode(c)) AS utf8_bytes,
      CAST(strlen(c) AS INTEGER) AS byte_length, count(*) AS n,
      CAST(min(i) AS INTEGER) AS first_position
    FROM (SELECT doc_id, unnest(string_split(text, '')) AS c,
      generate_subscripts(string_split(text, ''), 1) AS i FROM documents)
    WHERE strlen(c) > 1 GROUP BY ALL""",
)
def txt_non_ascii_chars(spark, sf):
    documents = views.read(spark, sf, "documents").select("doc_id", "text")
    chars = ddl.character_bytes(documents, "text", only_non_ascii=True)
    return chars.groupBy("doc_id", "char", "utf8_bytes", "byte_length").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position")
    )
