"""Reconciliation of two tables: columns, cells, grain and specification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgeframe.functions.text import plain_decimal, to_number
from lodgeframe.functions.types import compare_type, short_type
from lodgeframe.functions.variance import same_text, var_pct_null_aware
from lodgeframe.operators.joins import ROWS, only_in, only_keys, outer_join_keys, outer_join_on, sides_by_key
from lodgeframe.operators.sets import number_rows
from lodgeframe.operators.shape import all_in, quoted
from lodgeframe.sources.scratch import written

# Differences beyond this many decimal places are noise.
FLOAT_PLACES = 10

NO_MAPPING = "*no mapping*"
ACCEPTED = ["0", "MATCH"]


# ---------------------------------------------------------------- columns


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename old columns to their new names, leaving those without a mapping."""
    return df.withColumnsRenamed(
        {old: new for old, new in mapping.items() if new != NO_MAPPING and old in df.columns}
    )


def name_relation(df: DataFrame, name: str = "column_name") -> DataFrame:
    """The column names of a table as rows."""
    fields = T.StructType([T.StructField(name, T.StringType()), T.StructField("ordinal", T.IntegerType())])
    rows = [(c, i + 1) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, fields)


def column_report(
    test: DataFrame, prod: DataFrame, mapping: DataFrame, name: str = "column_name"
) -> DataFrame:
    """Which columns exist where, and under which name in prod.

    ``test`` and ``prod`` are relations of column names, ``mapping`` has the
    columns ``old`` (prod's name) and ``new`` (test's name).
    """
    mapping = mapping.filter(F.col("new") != NO_MAPPING)
    renamed = prod.join(mapping, F.col(name) == F.col("old"), "left").select(
        F.coalesce("new", name).alias(name)
    )
    both = outer_join_on(test.select(name), renamed, [name])
    exists = {
        f"exists_{side}": F.when(F.col(flag), F.lit("yes")).otherwise(F.lit("no"))
        for side, flag in [("test", "in_left"), ("prod", "in_right")]
    }
    matched = F.col("in_left") & F.col("in_right")
    reason = F.when(~F.col("in_left"), F.lit("in prod, not in test")).when(
        ~F.col("in_right"), F.lit("in test, not in prod")
    )
    old_names = mapping.select(
        F.col("new").alias(name), F.col("old").alias("existing column_name prod")
    )
    return (
        both.join(old_names, name, "left")
        .withColumns(exists)
        .select(
            name,
            "exists_test",
            "exists_prod",
            F.when(matched, F.lit("no")).otherwise(F.lit("yes")).alias("variance"),
            "`existing column_name prod`",
            reason.alias("variance reason"),
            F.when(matched, F.coalesce("existing column_name prod", name)).alias(
                "column name prod"
            ),
        )
    )


def select_columns(report: DataFrame, only_mapped: bool = False) -> DataFrame:
    """The columns to compare: in both tables, no warehouse bookkeeping."""
    chosen = report.filter(
        F.col("column name prod").isNotNull() & ~F.col("column_name").startswith("dw_")
    )
    if only_mapped:
        chosen = chosen.filter(F.col("existing column_name prod").isNotNull())
    return chosen.select("column_name", F.col("column name prod").alias("column_name_prod"))


def align_types(
    df: DataFrame,
    warehouse_types: Mapping[str, str],
    places: int = FLOAT_PLACES,
    as_text: Sequence[str] = (),
) -> DataFrame:
    """Cast columns to the types they are compared as, and round floating-point ones.

    A value that does not fit its type is null; in the columns ``as_text`` values are given as the text
    of the type, and such a value as its own text, so that it still differs from others.
    """
    casts = {}
    for name in df.columns:
        target = compare_type(warehouse_types.get(name, "character varying"))
        value = F.col(quoted(name)).try_cast(target)
        value = F.round(value, places) if target == "double" else value
        if name in as_text:
            value = F.coalesce(value.cast("string"), F.col(quoted(name)).cast("string"))
        casts[name] = value
    return df.select(*[c.alias(n) for n, c in casts.items()])


# ---------------------------------------------------------------- notes

# Why something could not be compared.
BAD_VALUE = "value does not fit its type"
BAD_KEY = "key does not fit its type, row left out"
NO_ROWS = "no rows"


def _unfit(name: str, warehouse_types: Mapping[str, str]) -> Column:
    """Whether a value is there but not as the type it is compared as."""
    target = compare_type(warehouse_types.get(name, "character varying"))
    return F.col(quoted(name)).isNotNull() & F.col(quoted(name)).try_cast(target).isNull()


def has_unfit(names: Sequence[str], warehouse_types: Mapping[str, str]) -> Column:
    return reduce(lambda a, b: a | b, [_unfit(c, warehouse_types) for c in names], F.lit(False))


def unfit_values(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    warehouse_types: Mapping[str, str],
    side: str,
    note: str = BAD_VALUE,
) -> DataFrame:
    """A row for each value of ``columns`` that does not fit the type it is compared as, with its text and the row's keys.

    The keys are given as their types, null where they do not fit. One scan and no shuffle.
    """
    found = [
        F.when(
            _unfit(c, warehouse_types),
            F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).cast("string").alias("value")),
        )
        for c in columns
    ]
    none = F.lit(None).cast("struct<column_name: string, value: string>")
    return (
        df.where(has_unfit(columns, warehouse_types))
        .select(*[_as_key(k, warehouse_types) for k in keys], F.inline(F.array_compact(F.array(*found, none))))
        .select(*map(quoted, keys), F.lit(side).alias("side"), "column_name", "value", F.lit(note).alias("note"))
    )


def _as_key(name: str, warehouse_types: Mapping[str, str]) -> Column:
    target = compare_type(warehouse_types.get(name, "character varying"))
    return F.col(quoted(name)).try_cast(target).alias(name)


def keys_without_rows(
    population: DataFrame,
    sides: Mapping[str, DataFrame],
    keys: Sequence[str],
    population_keys: Sequence[str],
    warehouse_types: Mapping[str, str],
) -> DataFrame:
    """A row for each key of the population and side that has no rows of it, in the columns of unfit_values().

    Keys of all tables are stacked and grouped, counted in part before the one shuffle; missing keys match missing ones.
    """
    names = [quoted(k) for k in population_keys]
    typed = [_as_key(k, warehouse_types) for k in population_keys]
    stacked = population.select(*typed, F.lit("").alias("side"))
    for side, df in sides.items():
        stacked = stacked.unionByName(df.select(*typed, F.lit(side).alias("side")))
    marks = [F.bool_or(F.col("side") == side).alias(f"in {side}") for side in sides]
    grouped = stacked.groupBy(*names).agg(F.bool_or(F.col("side") == "").alias("chosen"), *marks).where("chosen")
    lacks = [F.when(~F.col(f"`in {side}`"), F.lit(side)) for side in sides]
    return grouped.select(*names, F.explode(F.array_compact(F.array(*lacks))).alias("side")).select(
        *[
            F.col(quoted(k)) if k in population_keys
            else F.lit(None).cast(compare_type(warehouse_types.get(k, "character varying"))).alias(k)
            for k in keys
        ],
        "side",
        F.lit(None).cast("string").alias("column_name"),
        F.lit(None).cast("string").alias("value"),
        F.lit(NO_ROWS).alias("note"),
    )


# ---------------------------------------------------------------- cells


def check_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Raise if a key repeats. Rows are counted per key; no group is gathered."""
    repeated = df.groupBy(*[quoted(k) for k in keys]).count().filter("count > 1").limit(5)
    found = repeated.collect()
    if found:
        examples = [tuple(r)[:-1] for r in found]
        raise ValueError(f"{what}: {list(keys)} is no key, repeated are {examples}")


def _checked(found: DataFrame, keys: Sequence[str], what: str, at_once: bool) -> DataFrame:
    """Rows of sides_by_key(), or some that include all repeated keys, without ``ROWS``. Repeated keys are refused: at once, for
    which the rows are written and only their counts read, or when they are met."""
    if not at_once:
        return only_keys(found, keys, what)
    found = written(found, "sides")
    repeated = found.filter(F.col(quoted(ROWS)) > 1).select(*map(quoted, keys)).limit(5).collect()
    if repeated:
        raise ValueError(f"{what}: {list(keys)} is no key, repeated are {[tuple(r) for r in repeated]}")
    return found.drop(ROWS)


def _rounded(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.round(column, FLOAT_PLACES)
    return column


def _differ(a: Column, b: Column, a_type: T.DataType, b_type: T.DataType) -> Column:
    """Whether two values differ, the same way round or the other: as rounded numbers if either is
    floating-point, as they are if both are numbers or of one type, and otherwise as text."""
    floating = (T.FloatType, T.DoubleType)
    if isinstance(a_type, T.NumericType) and isinstance(b_type, T.NumericType):
        if isinstance(a_type, floating) or isinstance(b_type, floating):
            a, b = a.cast("double"), b.cast("double")
            # rounding is slow, and equal numbers stay equal
            return ~a.eqNullSafe(b) & ~F.round(a, FLOAT_PLACES).eqNullSafe(F.round(b, FLOAT_PLACES))
    elif type(a_type) is not type(b_type):
        a, b = a.cast("string"), b.cast("string")
    return ~a.eqNullSafe(b)


def _types(df: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.select(*map(quoted, columns)).schema.fields}


def compare_cells(
    test: DataFrame,
    prod: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    check_keys: bool = True,
    placed_by: Sequence[str] | None = None,
    population: DataFrame | None = None,
    population_keys: Sequence[str] = (),
) -> DataFrame:
    """The cells that differ, one row each, missing equal to missing.

    Rows are brought together by key, in one shuffle of both tables. ``row_found`` tells rows of one side only, whose
    filled cells are all listed. Rows without a difference are dropped before cells are laid out. Repeated keys are
    refused: at once with ``check_keys``, which writes the rows that differ, else when they are met.
    ``placed_by`` as in stack_by_key(). With a ``population`` only its keys count, found among the rows that differ.
    """
    if columns is None:
        columns = [c for c in test.columns if c in prod.columns and c not in keys]
    names = [quoted(c) for c in [*keys, *columns]]
    joined = sides_by_key(test.select(*names), prod.select(*names), keys, ("_test", "_prod"), placed_by)
    of_test, of_prod = _types(test, columns), _types(prod, columns)
    cells, differs = [], []
    for c in columns:
        a, b = F.col(quoted(f"{c}_test")), F.col(quoted(f"{c}_prod"))
        differs.append(_differ(a, b, of_test[c], of_prod[c]))
        a, b = _rounded(a, of_test[c]), _rounded(b, of_prod[c])
        cells.append(
            F.when(
                differs[-1],
                F.struct(
                    F.lit(c).alias("column_name"),
                    a.cast("string").alias("test_value"),
                    b.cast("string").alias("prod_value"),
                ),
            )
        )
    one_sided = ~(F.col("in_left") & F.col("in_right"))
    row_found = (
        F.when(F.col("in_left") & F.col("in_right"), F.lit("both"))
        .when(F.col("in_left"), F.lit("test only"))
        .otherwise(F.lit("prod only"))
    )
    wanted = joined.filter(reduce(lambda x, y: x | y, differs, one_sided | (F.col(quoted(ROWS)) > 1)))
    if population is not None:
        wanted = only_in(wanted, population, population_keys)
    found = _checked(wanted, keys, "test or prod", check_keys)
    return found.select(
        *[quoted(k) for k in keys],
        row_found.alias("row_found"),
        F.inline(F.array_compact(F.array(*cells))),
    )


def compare_wide(
    test: DataFrame,
    prod: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    check_keys: bool = True,
) -> DataFrame:
    """The rows found on both sides that differ, each column's two values where they do.

    Missing parts of a key match each other, and repeated keys are refused, as in compare_cells().
    """
    names = [quoted(c) for c in [*keys, *columns]]
    of_test, of_prod = _types(test, columns), _types(prod, columns)
    paired = sides_by_key(test.select(*names), prod.select(*names), keys, ("_test", "_prod"))
    out, differs = [], []
    for c in columns:
        a, b = F.col(quoted(f"{c}_test")), F.col(quoted(f"{c}_prod"))
        differs.append(_differ(a, b, of_test[c], of_prod[c]))
        a, b = _rounded(a, of_test[c]), _rounded(b, of_prod[c])
        out += [
            F.when(differs[-1], a).alias(f"{c}_test"),
            F.when(differs[-1], b).alias(f"{c}_prod"),
        ]
    both = F.col("in_left") & F.col("in_right")
    wanted = (both & reduce(lambda x, y: x | y, differs)) | (F.col(quoted(ROWS)) > 1)
    found = _checked(paired.filter(wanted), keys, "test or prod", check_keys)
    return found.select(*[quoted(k) for k in keys], *out)


def compare_tidy(
    test: DataFrame,
    prod: DataFrame,
    group: Sequence[str],
    order_by: Sequence[str],
    small_groups: bool = False,
) -> DataFrame:
    """Every cell of two tables paired by position, within each group of rows.

    Rows are paired by their number in the declared order, columns by their
    place. Values that are both numbers are compared as numbers rounded to ten
    places, others as text; missing equals missing. Counts that differ get a
    row of their own. ``small_groups`` as in number_rows(); rows are then paired where they are numbered.
    """
    test_columns = [c for c in test.columns if c not in group]
    prod_columns = [c for c in prod.columns if c not in group]
    positions = range(max(len(test_columns), len(prod_columns)))
    # columns are addressed by place from here on; the order is given by test's names
    order_at = [test_columns.index(c) for c in order_by]

    def numbered(df: DataFrame, columns: list[str], side: str) -> DataFrame:
        placed = df.select(
            *[quoted(g) for g in group],
            *[F.col(quoted(c)).alias(f"{side}{i}") for i, c in enumerate(columns)],
        )
        order = [f"{side}{i}" for i in order_at if i < len(columns)]
        return number_rows(placed, order, partition_by=group, small_groups=small_groups)

    a, b = numbered(test, test_columns, "t"), numbered(prod, prod_columns, "p")
    # both branches below read them
    placed_by = group if small_groups else None
    paired = written(outer_join_keys(a, b, [*group, "row_num"], placed_by=placed_by), "paired")

    types = {"t": test.select(*map(quoted, test_columns)).schema.fields}
    types["p"] = prod.select(*map(quoted, prod_columns)).schema.fields

    def number(side: str, i: int, text: Column) -> Column:
        fields = types[side]
        if i < len(fields) and isinstance(fields[i].dataType, T.NumericType):
            return F.nanvl(F.col(f"{side}{i}").cast("double"), F.lit(None).cast("double"))
        return to_number(text)

    def difference(a: Column, b: Column) -> Column:
        # rounding is slow, and most numbers are equal
        rounded = F.round(a, FLOAT_PLACES) - F.round(b, FLOAT_PLACES)
        return F.when(a - b == 0, F.lit(0.0)).otherwise(F.round(rounded, FLOAT_PLACES))

    missing_row = {
        "t": F.when(~F.col("in_left"), F.lit("ROW MISSING IN TEST")),
        "p": F.when(~F.col("in_right"), F.lit("ROW MISSING IN PROD")),
    }
    sides = {"t": (test_columns, "TEST"), "p": (prod_columns, "PROD")}

    def value(side: str, i: int) -> Column:
        columns, label = sides[side]
        if i >= len(columns):
            return F.lit(f"COLUMN MISSING IN {label}")
        return F.coalesce(missing_row[side], F.col(f"{side}{i}").cast("string"))

    # the values of a row are made once, then laid out as one row per cell
    values, cells = [], []
    for i in positions:
        t_name = test_columns[i] if i < len(test_columns) else None
        p_name = prod_columns[i] if i < len(prod_columns) else None
        label = f"{t_name} / {p_name}" if t_name and p_name and t_name != p_name else t_name or p_name
        t, p = value("t", i), value("p", i)
        gap = difference(number("t", i, t), number("p", i, p))
        values += [t.alias(f"test{i}"), p.alias(f"prod{i}"), gap.alias(f"gap{i}")]
        t, p, gap = F.col(f"test{i}"), F.col(f"prod{i}"), F.col(f"gap{i}")
        same = F.when(gap.isNotNull(), gap == 0).otherwise(t.eqNullSafe(p))
        cells.append(
            F.struct(
                F.lit(i + 1).alias("column_position"),
                F.lit(label).alias("column_name"),
                t.alias("test_value"),
                p.alias("prod_value"),
                gap.alias("variance"),
                F.when(same, F.lit("Y")).otherwise(F.lit("N")).alias("match"),
            )
        )
    keys = [quoted(g) for g in group]
    body = paired.select(
        *keys, F.col("row_num").cast("string").alias("row_num"), *values
    ).select(*keys, "row_num", F.inline(F.array(*cells)))
    counts = paired.groupBy(*keys).agg(
        F.count_if("in_left").alias("t"), F.count_if("in_right").alias("p")
    )
    widths = (F.lit(len(test_columns)).cast("bigint"), F.lit(len(prod_columns)).cast("bigint"))

    def count_row(label: str, t: Column, p: Column) -> Column:
        return F.when(
            t != p,
            F.struct(
                F.lit(label).alias("column_name"),
                t.cast("string").alias("test_value"),
                p.cast("string").alias("prod_value"),
                (t - p).cast("double").alias("variance"),
            ),
        )

    heads = counts.select(
        *keys,
        F.lit("ALL").alias("row_num"),
        F.lit(None).cast("int").alias("column_position"),
        F.inline(
            F.array_compact(
                F.array(
                    count_row("__ROW_COUNT__", F.col("t"), F.col("p")),
                    count_row("__COLUMN_COUNT__", *widths),
                )
            )
        ),
    ).withColumn("match", F.lit("N"))
    return body.unionByName(heads)


# ---------------------------------------------------------------- source against target


def stack_sides(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    check_keys: bool = True,
    placed_by: Sequence[str] | None = None,
) -> DataFrame:
    """SOURCE, TARGET and VARIANCE rows for every key, all values as text.

    A variance cell is the difference of two numbers ('0' if there is none), or
    MATCH or MISMATCH for other values and for rows found on one side only. ``placed_by`` as in stack_by_key().
    """
    columns = [c for c in source.columns if c not in keys]
    of_source, of_target = _types(source, columns), _types(target, columns)
    joined = sides_by_key(source, target.select(*map(quoted, source.columns)), keys, ("_s", "_t"), placed_by)
    joined = _checked(joined, keys, "source or target", check_keys)
    rows = {"SOURCE": [], "TARGET": [], "VARIANCE": []}
    both = F.col("in_left") & F.col("in_right")
    for c in columns:
        s, t = F.col(quoted(f"{c}_s")), F.col(quoted(f"{c}_t"))
        rows["SOURCE"].append(s.cast("string").alias(c))
        rows["TARGET"].append(t.cast("string").alias(c))
        equal = ~_differ(s, t, of_source[c], of_target[c])
        match = F.when(both & equal, F.lit("MATCH")).otherwise(F.lit("MISMATCH"))
        if isinstance(of_source[c], T.NumericType) and isinstance(of_target[c], T.NumericType):
            number = s.cast("double") - t.cast("double")
            gap = F.when((both & s.isNull() & t.isNull()) | (number == 0), F.lit("0")).otherwise(
                plain_decimal(F.round(number, FLOAT_PLACES))
            )
            match = F.when(both, F.coalesce(gap, F.lit("MISMATCH"))).otherwise(match)
        rows["VARIANCE"].append(match.alias(c))
    present = {"SOURCE": F.col("in_left"), "TARGET": F.col("in_right"), "VARIANCE": F.lit(True)}
    stacked = F.array_compact(
        F.array(
            *[
                F.when(present[tag], F.struct(F.lit(tag).alias("row_source"), *cells))
                for tag, cells in rows.items()
            ]
        )
    )
    return joined.select(*[quoted(k) for k in keys], F.inline(stacked))


def flag_variance(stacked: DataFrame, exempt: Sequence[str]) -> DataFrame:
    """The VARIANCE rows, with 'yes' where any checked cell is neither '0' nor 'MATCH'."""
    rows = stacked.filter(F.col("row_source") == "VARIANCE")
    checked = [c for c in stacked.columns if c not in exempt and c != "row_source"]
    return rows.select(
        F.when(all_in(checked, ACCEPTED), F.lit("no")).otherwise(F.lit("yes")).alias("is_variance"),
        *[quoted(c) for c in stacked.columns],
    )


# ---------------------------------------------------------------- extracts


def check_extracts(select: DataFrame, table: DataFrame, grain: Sequence[str]) -> None:
    """Raise unless both have the grain and the select has every other column of the table."""
    for what, df in (("select", select), ("table", table)):
        lost = [g for g in grain if g not in df.columns]
        if lost:
            raise ValueError(f"{what} lacks the grain columns {lost}")
    extra = [c for c in table.columns if c not in select.columns]
    if extra:
        raise ValueError(f"select lacks the columns {extra}")


def compare_extracts(
    select: DataFrame,
    table: DataFrame,
    grain: Sequence[str],
    texts: Sequence[str] = (),
    measures: Sequence[str] = (),
    missing_from: str = "one",
    strict: bool = False,
    check_keys: bool = True,
) -> DataFrame:
    """Two extracts side by side on their grain, with text and percentage variances."""
    check_extracts(select, table, grain)
    joined = sides_by_key(select, table, grain, ("_select", "_table")).drop("in_left", "in_right")
    joined = _checked(joined, grain, "select or table", check_keys)
    rest = sorted(c for c in joined.columns if c not in grain)
    joined = joined.select(*[quoted(c) for c in [*grain, *rest]])
    added = {}
    for c in texts:
        a, b = F.col(quoted(f"{c}_select")), F.col(quoted(f"{c}_table"))
        added[f"{c}_variance"] = same_text(a, b, strict)
    for c in measures:
        a, b = F.col(quoted(f"{c}_select")), F.col(quoted(f"{c}_table"))
        added[f"{c}_var %"] = var_pct_null_aware(a, b, missing_from)
    return joined.withColumns(added)


# ---------------------------------------------------------------- specification


def compare_spec(spec: DataFrame, catalog: DataFrame) -> DataFrame:
    """Object, length and type of each specified column against those in the catalog.

    Both have schema, object, column_name, data_type and length; the
    specification may have net_new.
    """
    both = outer_join_on(spec, catalog, ["column_name"], ("_spec", "_target"))
    adjusted = short_type(F.col("data_type_target"))

    def good(test: Column) -> Column:
        return F.when(test, F.lit("good")).otherwise(F.lit("bad"))

    tests = {
        "object_validation": F.col("object_spec").eqNullSafe(F.col("object_target")),
        "length_validation": F.col("length_spec").eqNullSafe(F.col("length_target")),
        "data_type_validation": F.col("data_type_spec").eqNullSafe(adjusted),
    }
    checked = both.withColumn("data_type_target_adjusted", adjusted).withColumns(
        {name: good(test) for name, test in tests.items()}
    )
    checked = checked.withColumn(
        "total_validation", good(reduce(lambda a, b: a & b, [F.col(t) == "good" for t in tests]))
    )
    order = [
        "total_validation",
        "net_new",
        "schema_spec",
        "schema_target",
        "object_spec",
        "object_target",
        "object_validation",
        "column_name",
        "length_spec",
        "length_target",
        "length_validation",
        "data_type_spec",
        "data_type_target",
        "data_type_target_adjusted",
        "data_type_validation",
    ]
    return checked.select(*[c for c in order if c in checked.columns])
