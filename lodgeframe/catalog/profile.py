"""Queries of column profiles and their merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgeframe import views
from lodgeframe.catalog.registry import query
from lodgeframe.operators.profile import METRICS, merge_file_profiles, merge_profiles, profile_files, profile_table
from lodgeframe.operators.sets import union_all

# Columns of the profiled tables and their types in a profile.
SHAPES = {
    "documents": {
        "doc_id": "Int64", "text": "String", "lang": "String", "source": "String",
        "n_chars": "Int64",
    },
    "part": {
        "p_partkey": "Int64", "p_name": "String", "p_brand": "String", "p_type": "String",
        "p_size": "Int64", "p_retailprice": "Float64",
    },
    "notes": {"note_id": "Int64", "note": "String", "nothing": "String"},
    "lineitem": {
        "l_orderkey": "Int64", "l_partkey": "Int64", "l_suppkey": "Int64",
        "l_linenumber": "Int64", "l_quantity": "Float64", "l_extendedprice": "Float64",
        "l_discount": "Float64", "l_tax": "Float64", "l_returnflag": "String",
        "l_linestatus": "String", "l_shipdate": "timestamp_ntz",
    },
    "events": {
        "event_id": "Int64", "user_id": "Int64", "event_type": "String", "value": "Float64",
        "props": "String", "ts": "timestamp_ntz",
    },
}

# Texts with blanks, missing values and whitespace of several kinds at the ends.
NOTES = """
notes AS (SELECT doc_id AS note_id,
  CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || lang WHEN 2 THEN lang || chr(160)
    WHEN 3 THEN chr(8232) || source || chr(9) WHEN 4 THEN NULL WHEN 5 THEN ' '
    ELSE text END AS note,
  CAST(NULL AS VARCHAR) AS nothing FROM documents)"""


def notes(spark, sf):
    case = F.col("doc_id") % 7
    return views.read(spark, sf, "documents").select(
        F.col("doc_id").alias("note_id"),
        F.when(case == 0, F.lit(""))
        .when(case == 1, F.concat(F.lit(" "), "lang"))
        .when(case == 2, F.concat("lang", F.lit("\u00a0")))
        .when(case == 3, F.concat(F.lit("\u2028"), "source", F.lit("\t")))
        .when(case == 4, F.lit(None).cast("string"))
        .when(case == 5, F.lit(" "))
        .otherwise(F.col("text"))
        .alias("note"),
        F.lit(None).cast("string").alias("nothing"),
    )


def profiled(spark, sf, table):
    if table == "notes":
        return notes(spark, sf)
    return views.read(spark, sf, table).select(*SHAPES[table])


# What RE2 takes for whitespace is ASCII only, so the characters are listed.
_SPACE = (
    r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}]"
)


def _metric_sql(metric: str, c: str, kind: str, table: str) -> str:
    lead, end = f"regexp_matches({c}, '^{_SPACE}')", f"regexp_matches({c}, '{_SPACE}$')"

    def first(order: str) -> str:
        return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL ORDER BY {order}, {c} LIMIT 1)"

    every = {
        "row_count": "count(*)",
        "null_count": f"count(*) FILTER ({c} IS NULL)",
        "is_completely_null": f"CASE WHEN count({c}) = 0 THEN 'yes' ELSE 'no' END",
        "min_value": f"CAST(min({c}) AS VARCHAR)",
        "max_value": f"CAST(max({c}) AS VARCHAR)",
        "count_of_distinct_values": f"count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS BIGINT)",
    }
    text = {
        "character_blank_count": f"count(*) FILTER ({c} = '')",
        "min_length_of_characters": f"CAST(min(length({c})) AS INTEGER)",
        "value_with_min_length_of_characters": first(f"length({c})"),
        "max_length_of_characters": f"CAST(max(length({c})) AS INTEGER)",
        "value_with_max_length_of_characters": first(f"-length({c})"),
        "max_octet_length": f"CAST(max(strlen({c})) AS INTEGER)",
        "value_with_max_octet_length": first(f"-strlen({c})"),
        "avg_length_of_characters": f"CAST(ceil(avg(length({c}))) AS INTEGER)",
        "value_with_avg_length_of_characters": f"(SELECT min({c}) FROM {table} WHERE length({c}) = "
        f"(SELECT ceil(avg(length({c}))) FROM {table}))",
        "count_of_values_with_leading_whitespace": f"count(*) FILTER ({lead})",
        "count_of_values_with_ending_whitespace": f"count(*) FILTER ({end})",
        "count_of_values_with_beginning_and_ending_whitespace": f"count(*) FILTER ({lead} AND {end})",
    }
    types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}
    null = f"CAST(NULL AS {types[METRICS[metric]]})"
    expression = every.get(metric) or (text[metric] if kind == "String" else null)
    return f"{expression} AS {metric}"


def profile_sql(table: str, metrics, source: str | None = None) -> str:
    """One row per column; ``source`` names the relation if it is not the table."""
    source = source or table
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, '{kind}' AS data_type, "
        + ", ".join(_metric_sql(m, c, kind, source) for m in metrics)
        + f" FROM {source} HAVING count(*) >= 0"
        for c, kind in SHAPES[table].items()
    )


def _register_metric(metric: str):
    tables = ["documents", "part", "notes"]
    body = " UNION ALL ".join(profile_sql(t, [metric]) for t in tables)

    @query(f"prof_{metric}", f"WITH {NOTES} {body}")
    def run(spark, sf):
        return union_all([profile_table(profiled(spark, sf, t), [metric]) for t in tables])


for _metric in METRICS:
    _register_metric(_metric)


@query(
    "prof_data_type",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, '{k}' AS data_type, count({c}) AS value_count FROM {t}"
        for t in ("documents", "part", "events")
        for c, k in SHAPES[t].items()
    ),
)
def prof_data_type(spark, sf):
    parts = []
    for t in ("documents", "part", "events"):
        counts = profile_table(profiled(spark, sf, t), ["row_count", "null_count"])
        value_count = (F.col("row_count") - F.col("null_count")).alias("value_count")
        parts.append(counts.select("field", "data_type", value_count))
    return union_all(parts)


def _register_table(name: str, table: str, metrics=None):
    chosen = [m for m in METRICS if metrics is None or m in metrics]
    sql = profile_sql(table, chosen)

    @query(name, f"WITH {NOTES} {sql}" if table == "notes" else sql)
    def run(spark, sf):
        return profile_table(profiled(spark, sf, table), metrics)


_register_table("profile_table", "documents")
_register_table("profile_table_lineitem", "lineitem")
_register_table("profile_table_events", "events")
_register_table("profile_table_notes", "notes")
_register_table("profile_switches", "lineitem", ["row_count", "null_count", "max_octet_length"])


# ---------------------------------------------------------------- merging

LANGS = ["en", "de", "es", "fr"]


def _merge_sql(table: str, files: dict[str, str], keep_first: bool = True) -> str:
    """Merge of the profiles of several relations, by the merging rules."""
    parts = " UNION ALL ".join(
        f"SELECT {i} AS file_order, * FROM ({profile_sql(table, METRICS, f)}) WHERE row_count > 0"
        for i, f in enumerate(files)
    )
    relations = ", ".join(f"{name} AS ({sql})" for name, sql in files.items())
    whitespace = ", ".join(f"max({m}) AS {m}" for m in METRICS if "whitespace" in m)

    def pick(value: str, order: str) -> str:
        return (
            f"arg_min({value}, ({order}, file_order)) FILTER ({value} <> '') AS {value}"
        )

    def extreme(f: str) -> str:
        v = f"{f}_value"
        return (
            f"CASE WHEN any_value(data_type) NOT IN ('Int64', 'Float64') THEN {f}({v}) FILTER ({v} <> '') "
            f"WHEN any_value(data_type) = 'Int64' THEN CAST({f}(TRY_CAST({v} AS BIGINT)) AS VARCHAR)"
            f" ELSE CAST({f}(TRY_CAST({v} AS DOUBLE)) AS VARCHAR) END AS {v}"
        )

    return f"""WITH {relations}, profiles AS ({parts})
    SELECT field, count(*) AS file_count, any_value(data_type) AS data_type,
      CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(null_count) AS BIGINT) AS null_count,
      CASE WHEN bool_and(is_completely_null = 'yes') THEN 'yes' ELSE 'no' END AS is_completely_null,
      CAST(sum(character_blank_count) AS BIGINT) AS character_blank_count,
      {extreme("min")}, {extreme("max")},
      min(min_length_of_characters) AS min_length_of_characters,
      max(max_length_of_characters) AS max_length_of_characters,
      max(max_octet_length) AS max_octet_length,
      {pick("value_with_min_length_of_characters", "length(value_with_min_length_of_characters)")},
      {pick("value_with_max_length_of_characters", "-length(value_with_max_length_of_characters)")},
      {pick("value_with_max_octet_length", "-strlen(value_with_max_octet_length)")},
      max(avg_length_of_characters) AS avg_length_of_characters,
      {pick("value_with_avg_length_of_characters", "-length(value_with_avg_length_of_characters)")},
      CAST(ceil(avg(count_of_distinct_values)) AS BIGINT) AS count_of_distinct_values, {whitespace}
    FROM profiles GROUP BY field"""


def _parts(prefix: str, table: str, column: str, values) -> dict[str, str]:
    """A relation for each value, and one for rows with none of them; those without rows are no files."""
    listed = ", ".join(f"'{v}'" for v in values)
    rest = f"{column} IS NULL OR {column} NOT IN ({listed})"
    tests = {**{v: f"{column} = '{v}'" for v in values}, "rest": rest}
    return {f"{prefix}_{name}": f"SELECT * FROM {table} WHERE {test}" for name, test in tests.items()}


def _merged_parts(df, column: str, values):
    """The merged profile of the parts of a table, all profiled in one run."""
    part = F.when(F.col(column).isin(*values), F.col(column)).otherwise(F.lit("rest"))
    return merge_file_profiles(profile_files(df.withColumn("part", part), "part"), "part", values)


@query("profile_merge", _merge_sql("documents", _parts("doc", "documents", "lang", LANGS)))
def profile_merge(spark, sf):
    return _merged_parts(profiled(spark, sf, "documents"), "lang", LANGS)


@query("profile_merge_numbers", _merge_sql("lineitem", _parts("lines", "lineitem", "l_returnflag", "ANR")))
def profile_merge_numbers(spark, sf):
    return _merged_parts(profiled(spark, sf, "lineitem"), "l_returnflag", list("ANR"))


@query(
    "profile_merge_types",
    f"""WITH ids AS (SELECT doc_id AS v FROM documents), texts AS (SELECT text AS v FROM documents),
      prices AS (SELECT p_retailprice AS v, p_size AS w FROM part),
      sizes AS (SELECT p_size AS v, p_retailprice AS w FROM part)
    SELECT 'ids_texts' AS pair, 'v' AS field, 'String' AS data_type,
      (SELECT count(*) FROM ids) + (SELECT count(*) FROM texts) AS row_count
    UNION ALL SELECT 'prices_sizes', f, 'Float64', 2 * (SELECT count(*) FROM part)
      FROM (VALUES ('v'), ('w')) AS fields(f)
    UNION ALL SELECT 'prices_texts', 'v', NULL,
      (SELECT count(*) FROM prices) + (SELECT count(*) FROM texts)
    UNION ALL SELECT 'prices_texts', 'w', 'Int64', (SELECT count(*) FROM part)""",
)
def profile_merge_types(spark, sf):
    part, documents = views.read(spark, sf, "part"), views.read(spark, sf, "documents")
    price, size = F.col("p_retailprice"), F.col("p_size")
    tables = {
        "ids": documents.select(F.col("doc_id").alias("v")),
        "texts": documents.select(F.col("text").alias("v")),
        "prices": part.select(price.alias("v"), size.alias("w")),
        "sizes": part.select(size.alias("v"), price.alias("w")),
    }
    profiles = {name: profile_table(df, position=True) for name, df in tables.items()}
    parts = []
    for a, b in (("ids", "texts"), ("prices", "sizes"), ("prices", "texts")):
        merged = merge_profiles([profiles[a], profiles[b]], on_conflict="null")
        pair = F.lit(f"{a}_{b}").alias("pair")
        parts.append(merged.select(pair, "field", "data_type", "row_count"))
    return union_all(parts)
