"""Column profiles of a table, and the merging of the profiles of many files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgeframe.functions.text import WHITESPACE
from lodgeframe.functions.types import profile_type
from lodgeframe.functions.variance import order_in
from lodgeframe.operators.sets import union_all
from lodgeframe.operators.shape import quoted
from lodgeframe.sources.scratch import checkpointed, written

# The metrics of a profile, in report order, with their types.
METRICS = {
    "row_count": "bigint",
    "null_count": "bigint",
    "is_completely_null": "string",
    "character_blank_count": "bigint",
    "min_value": "string",
    "min_length_of_characters": "int",
    "value_with_min_length_of_characters": "string",
    "max_value": "string",
    "max_length_of_characters": "int",
    "value_with_max_length_of_characters": "string",
    "max_octet_length": "int",
    "value_with_max_octet_length": "string",
    "avg_length_of_characters": "int",
    "value_with_avg_length_of_characters": "string",
    "count_of_distinct_values": "bigint",
    "count_of_values_with_leading_whitespace": "bigint",
    "count_of_values_with_ending_whitespace": "bigint",
    "count_of_values_with_beginning_and_ending_whitespace": "bigint",
}
COLUMNS = ["field", "data_type", *METRICS]

AVG_VALUE = "value_with_avg_length_of_characters"
AVG_LENGTH = "avg_length_of_characters"
DISTINCT = "count_of_distinct_values"
_OTHER_PASSES = (AVG_VALUE, DISTINCT)
FILE = "its_file"

# Wider tables are aggregated in several passes, each over some of the columns,
# to stay inside the size of generated code.
COLUMNS_PER_PASS = 50


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPACES = ", ".join(f"'\\u{ord(c):04x}'" for c in WHITESPACE)


def _string_metrics(v: str) -> dict[str, str]:
    leading = f"substring({v}, 1, 1) IN ({_SPACES})"
    ending = f"substring({v}, -1, 1) IN ({_SPACES})"

    def first_by(length: str) -> str:
        # of equally long values the smallest is shown
        return f"min(CASE WHEN {v} IS NOT NULL THEN struct({length} AS n, {v} AS v) END)"

    shortest, longest = first_by(f"length({v})"), first_by(f"-length({v})")
    widest = first_by(f"-octet_length({v})")
    return {
        "character_blank_count": f"count_if({v} = '')",
        "min_length_of_characters": f"{shortest}.n",
        "value_with_min_length_of_characters": f"{shortest}.v",
        "max_length_of_characters": f"-{longest}.n",
        "value_with_max_length_of_characters": f"{longest}.v",
        "max_octet_length": f"-{widest}.n",
        "value_with_max_octet_length": f"{widest}.v",
        AVG_LENGTH: f"ceil(avg(length({v})))",
        "count_of_values_with_leading_whitespace": f"count_if({leading})",
        "count_of_values_with_ending_whitespace": f"count_if({ending})",
        "count_of_values_with_beginning_and_ending_whitespace": f"count_if({leading} AND {ending})",
    }


def _column_metrics(name: str, data_type: T.DataType) -> dict[str, str]:
    v = quoted(name)
    metrics = {
        "row_count": "count(1)",
        "null_count": f"count_if({v} IS NULL)",
        "is_completely_null": f"if(count({v}) = 0, 'yes', 'no')",
        "min_value": f"min({v})",
        "max_value": f"max({v})",
    }
    if isinstance(data_type, T.StringType):
        metrics.update(_string_metrics(v))
    return metrics


def _one_pass(df: DataFrame, fields: Sequence[tuple[int, T.StructField]], metrics, by: Sequence[str] = ()) -> DataFrame:
    """All plain metrics of some columns, per group; written as SQL, one expression for all of them."""
    rows = []
    for position, field in fields:
        own = _column_metrics(field.name, field.dataType)
        cells = [f"CAST({own.get(m, 'NULL')} AS {METRICS[m]}) AS {m}" for m in metrics]
        head = [f"{position} AS position", f"{_literal(field.name)} AS field"]
        rows.append(f"struct({', '.join(head + cells)})")
    found = F.expr(f"array({', '.join(rows)})").alias("rows")
    grouped = df.groupBy(*by).agg(found) if by else df.agg(found)
    return grouped.select(*by, F.inline("rows"))


def profile_files(
    df: DataFrame,
    by: str,
    metrics: Iterable[str] | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """The profiles of all files of a subject, one row for each value of ``by`` (a file's name) and other column.

    The same number of jobs for any number of files: every metric is grouped by file, and distinct values are (file, column,
    value) rows. A missing ``by`` is a file of its own. ``position`` is the column's place; the rest is as in profile_table().
    The table is read three times: for the plain metrics, for the values of average length, and for distinct counts.
    """
    wanted = [m for m in METRICS if metrics is None or m in set(metrics)]
    if metrics is not None and set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(set(metrics) - set(METRICS))}")
    first_pass = [m for m in wanted if m not in _OTHER_PASSES]
    if AVG_VALUE in wanted and AVG_LENGTH not in first_pass:
        first_pass.append(AVG_LENGTH)
    own = df.withColumnRenamed(by, FILE).select(FILE, *[quoted(c) for c in df.columns if c != by])
    fields = list(enumerate(f for f in own.schema.fields if f.name != FILE))
    chunks = [fields[i : i + COLUMNS_PER_PASS] for i in range(0, len(fields), COLUMNS_PER_PASS)]
    plain = union_all([_one_pass(own, chunk, first_pass, [FILE]) for chunk in chunks])
    result = written(plain, "file-profiles")
    texts = [(i, f.name) for i, f in fields if isinstance(f.dataType, T.StringType)]
    if AVG_VALUE in wanted and texts:
        average = [F.max(F.when(F.col("position") == i, F.col(AVG_LENGTH))).alias(f"average {i}") for i, _ in texts]
        # one row a file
        of_file = result.groupBy(F.col(FILE).alias("of file")).agg(*average)
        fits = {i: F.length(quoted(n)) == F.col(f"`average {i}`") for i, n in texts}
        found = (
            own.join(of_file, own[FILE].eqNullSafe(of_file["of file"]))
            .where(reduce(lambda a, b: a | b, fits.values()))
            .groupBy(FILE)
            .agg(F.array(*[F.struct(F.lit(i).alias("place"), F.min(F.when(fits[i], F.col(quoted(n)))).alias(AVG_VALUE)) for i, n in texts]).alias("cells"))
            .select(F.col(FILE).alias("of file"), F.inline("cells"))
        )
        result = _joined(result, found)
    elif AVG_VALUE in wanted:
        result = result.withColumn(AVG_VALUE, F.lit(None).cast("string"))
    if DISTINCT in wanted:
        values = own.selectExpr(FILE, *[f"{_as_binary(f.name, f.dataType)} AS `{i}`" for i, f in fields])
        values = values.unpivot(FILE, [quoted(str(i)) for i, _ in fields], "place", "value").distinct()
        counts = values.groupBy(F.col(FILE).alias("of file"), F.col("place").cast("int").alias("place")).agg(
            F.count(F.lit(1)).alias(DISTINCT)
        )
        result = _joined(result, counts)
    names = {f.name: profile_type(f.dataType) for _, f in fields} | dict(types or {})
    type_rows = F.expr(f"array({', '.join(_literal(names[f.name]) for _, f in fields)})")
    return result.select(
        F.col(FILE).alias(by), "position", "field", F.get(type_rows, F.col("position")).alias("data_type"), *wanted
    )


def _joined(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """One row a file and column on both sides; a missing file is one of them."""
    same = profiles[FILE].eqNullSafe(found["of file"]) & (profiles["position"] == found["place"])
    return profiles.join(found, same, "left").drop("of file", "place")


def _average_values(df: DataFrame, fields: Iterable[str], base: DataFrame) -> DataFrame:
    """Per text column the smallest value of average length, if there is one."""
    fields = list(fields)
    # one number per column
    averages = {r["field"]: r[AVG_LENGTH] for r in base.select("field", AVG_LENGTH).collect()}
    rows = [
        f"struct({_literal(f)} AS field, min(CASE WHEN length({quoted(f)}) = "
        f"{'NULL' if averages[f] is None else averages[f]} THEN {quoted(f)} END) AS {AVG_VALUE})"
        for f in fields
    ]
    return (
        df.select(*[quoted(f) for f in fields])
        .agg(F.expr(f"array({', '.join(rows)})").alias("rows"))
        .select(F.inline("rows"))
    )


def _comparable(name: str, data_type: T.DataType) -> tuple[str, str]:
    """A kind of value, and the column as that kind.

    Whole numbers and floating-point numbers stay as they are. Texts are taken as their SHA-256 digests, so
    that long ones need not travel, and other values as text.
    """
    if isinstance(data_type, T.IntegralType):
        return "bigint", f"CAST({quoted(name)} AS BIGINT)"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double", f"CAST({quoted(name)} AS DOUBLE)"
    return "text", _as_binary(name, data_type)


def _as_binary(name: str, data_type: T.DataType) -> str:
    raw = f"CAST(CAST({quoted(name)} AS STRING) AS BINARY)"
    return f"unhex(sha2({raw}, 256))" if isinstance(data_type, T.StringType) else raw


def count_distinct(df: DataFrame, columnar: bool = True) -> DataFrame:
    """Number of distinct values of each column, a missing value counted as one.

    Columns are counted together: values are dealt out as (column, value) rows,
    and repeats are dropped before and after the shuffle, so a value that fills
    a third of the rows is one row per task. In a columnar source the numbers
    and the texts are dealt out separately, each reading its own columns;
    ``columnar=False`` takes all as text and scans the source once.
    """
    kinds: dict[str, dict[str, str]] = {}
    for i, field in enumerate(df.schema.fields):
        kind, value = "text", _as_binary(field.name, field.dataType)
        if columnar:
            kind, value = _comparable(field.name, field.dataType)
        kinds.setdefault(kind, {})[str(i)] = value
    counts = []
    for columns in kinds.values():
        values = df.selectExpr(*[f"{v} AS `{i}`" for i, v in columns.items()])
        values = values.unpivot([], [quoted(i) for i in columns], "position", "value").distinct()
        counts.append(values.groupBy("position").agg(F.count(F.lit(1)).alias(DISTINCT)))
    return union_all(counts).withColumn("position", F.col("position").cast("int"))


def profile_table(
    df: DataFrame,
    metrics: Iterable[str] | None = None,
    types: Mapping[str, str] | None = None,
    columnar: bool = True,
    position: bool = False,
) -> DataFrame:
    """One row per column with its type and metrics, and with ``position`` its place.

    Three passes over the data at most: one for all plain metrics, one for the
    values of average length, whose length must be known first, and one for
    distinct counts, which alone needs a shuffle of values. In a columnar
    source that last pass is split by kind of value; for text files
    ``columnar=False`` keeps it a single scan. ``types`` overrides the type
    names shown.
    """
    wanted = [m for m in METRICS if metrics is None or m in set(metrics)]
    if metrics is not None and set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(set(metrics) - set(METRICS))}")
    first_pass = [m for m in wanted if m not in _OTHER_PASSES]
    if AVG_VALUE in wanted and AVG_LENGTH not in first_pass:
        first_pass.append(AVG_LENGTH)

    fields = list(enumerate(df.schema.fields))
    chunks = [fields[i : i + COLUMNS_PER_PASS] for i in range(0, len(fields), COLUMNS_PER_PASS)]
    result = union_all([_one_pass(df, chunk, first_pass) for chunk in chunks])
    texts = [f.name for _, f in fields if isinstance(f.dataType, T.StringType)]
    if AVG_VALUE in wanted:
        # read twice from here on, and only as long as the table is wide
        result = checkpointed(result)
        if texts:
            result = result.join(_average_values(df, texts, result), "field", "left")
        else:
            result = result.withColumn(AVG_VALUE, F.lit(None).cast("string"))
    if DISTINCT in wanted:
        result = result.join(count_distinct(df, columnar), "position", "left")
    names = {f.name: profile_type(f.dataType) for _, f in fields} | dict(types or {})
    type_rows = F.expr(f"array({', '.join(_literal(names[f.name]) for _, f in fields)})")
    return (
        result.withColumn("data_type", F.get(type_rows, F.col("position")))
        .orderBy("position")
        .select(*(["position"] if position else []), "field", "data_type", *wanted)
    )


# ---------------------------------------------------------------- merging


def _known(name: str) -> Column:
    """Null for a blank."""
    c = F.col(name)
    return F.when(c.cast("string") != "", c)


def merged_type(types: Column) -> Column:
    """Type that holds all given types, null if there is none."""
    size = F.array_size(types)
    pair = F.concat_ws(",", F.sort_array(types))
    return (
        F.when(size == 1, F.get(types, F.lit(0)))
        .when(pair == "Float64,Int64", F.lit("Float64"))
        .when(pair == "Int64,String", F.lit("String"))
    )


def merge_profiles(
    profiles: Sequence[DataFrame] | Mapping[str, DataFrame],
    fields: str = "first",
    on_conflict: str = "raise",
) -> DataFrame:
    """One profile of a subject from the profiles of its files, in the given order.

    ``fields="first"`` keeps the fields of the first file, ``"union"`` all. Fields come in the order of the first file that
    has them, told by ``position`` where the profiles have it and else by the order of their rows.
    Types that do not go together raise an error, or give a null type with
    ``on_conflict="null"``.
    """
    frames = list(profiles.values()) if isinstance(profiles, Mapping) else list(profiles)
    rows = union_all(
        [
            p.withColumn("file_order", F.lit(i))
            .withColumn("field_order", F.col("position") if "position" in p.columns else F.monotonically_increasing_id())
            .drop("position")
            for i, p in enumerate(frames)
        ]
    )
    return _merged(rows, fields, on_conflict)


def merge_file_profiles(
    profiles: DataFrame,
    by: str,
    order: Sequence[str] = (),
    fields: str = "first",
    on_conflict: str = "raise",
) -> DataFrame:
    """The same from the rows of profile_files(). Files come in the given order, others by name after them."""
    # few rows: one a file
    names = profiles.select(by).distinct()
    place = F.row_number().over(Window.orderBy(order_in(list(order), F.col(quoted(by))), F.col(quoted(by)))) - 1
    placed = names.select(F.col(quoted(by)).alias("of file"), place.alias("file_order"))
    rows = profiles.join(placed, profiles[quoted(by)].eqNullSafe(placed["of file"])).drop("of file", by)
    return _merged(rows.withColumnRenamed("position", "field_order"), fields, on_conflict)


def _merged(rows: DataFrame, fields: str, on_conflict: str) -> DataFrame:
    """One row a field, from rows with ``file_order`` and ``field_order``."""
    if fields not in ("first", "union"):
        raise ValueError(f"fields must be 'first' or 'union', not {fields!r}")
    if on_conflict not in ("raise", "null"):
        raise ValueError(f"on_conflict must be 'raise' or 'null', not {on_conflict!r}")

    def by_number(name: str) -> Column:
        c = _known(name)
        return F.when(
            c.try_cast("double").isNotNull(),
            F.struct(c.try_cast("double").alias("d"), c.try_cast("bigint").alias("i"), c.alias("v")),
        )

    def longest(name: str, length) -> Column:
        c = _known(name)
        return F.min_by(c, F.when(c.isNotNull(), F.struct(-length(c), F.col("file_order"))))

    def shortest(name: str) -> Column:
        c = _known(name)
        return F.min_by(c, F.when(c.isNotNull(), F.struct(F.length(c), F.col("file_order"))))

    whitespace = [m for m in METRICS if "whitespace" in m]
    merged = rows.groupBy("field").agg(
        F.min("file_order").alias("first_file"),
        F.min_by("field_order", "file_order").alias("place"),
        F.count(F.lit(1)).alias("file_count"),
        merged_type(F.collect_set("data_type")).alias("data_type"),
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.when(F.bool_and(F.col("is_completely_null") == "yes"), F.lit("yes"))
        .otherwise(F.lit("no"))
        .alias("is_completely_null"),
        F.sum(_known("character_blank_count")).alias("character_blank_count"),
        F.min(by_number("min_value"))["v"].alias("min_number"),
        F.min(_known("min_value")).alias("min_text"),
        F.min(_known("min_length_of_characters")).alias("min_length_of_characters"),
        shortest("value_with_min_length_of_characters").alias(
            "value_with_min_length_of_characters"
        ),
        F.max(by_number("max_value"))["v"].alias("max_number"),
        F.max(_known("max_value")).alias("max_text"),
        F.max(_known("max_length_of_characters")).alias("max_length_of_characters"),
        longest("value_with_max_length_of_characters", F.length).alias(
            "value_with_max_length_of_characters"
        ),
        F.max(_known("max_octet_length")).alias("max_octet_length"),
        longest("value_with_max_octet_length", F.octet_length).alias(
            "value_with_max_octet_length"
        ),
        F.max(_known(AVG_LENGTH)).alias(AVG_LENGTH),
        longest(AVG_VALUE, F.length).alias(AVG_VALUE),
        F.ceil(F.avg(DISTINCT)).alias(DISTINCT),
        *[F.max(m).alias(m) for m in whitespace],
    )
    is_number = F.col("data_type").isin("Int64", "Float64")
    merged = merged.withColumns(
        {
            "min_value": F.when(is_number, F.col("min_number")).otherwise(F.col("min_text")),
            "max_value": F.when(is_number, F.col("max_number")).otherwise(F.col("max_text")),
        }
    )
    if fields == "first":
        merged = merged.filter(F.col("first_file") == 0)
    if on_conflict == "raise":
        merged = checkpointed(merged)
        bad = merged.filter(F.col("data_type").isNull()).select("field").limit(20).collect()
        if bad:
            raise ValueError(f"types do not go together for fields {sorted(r[0] for r in bad)}")
    return merged.orderBy("first_file", "place").select(
        "field", "file_count", "data_type", *METRICS
    )
