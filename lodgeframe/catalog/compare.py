"""Queries of table reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgeframe import views
from lodgeframe.catalog.joins import _SAMPLE, KEYS
from lodgeframe.catalog.registry import query
from lodgeframe.catalog.variance import null_aware_sql
from lodgeframe.operators import aggregates as agg
from lodgeframe.operators import compare as cmp
from lodgeframe.operators import joins
from lodgeframe.operators.sets import column_overlap, union_all
from lodgeframe.plans import reconciliation as recon
from lodgeframe.sources.tables import observed_schema

_KEYS = ", ".join(KEYS)
VALUES = ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
POP_KEYS = ["l_orderkey"]

# ---------------------------------------------------------------- columns

# Prod's names for some of the columns; one has no counterpart.
MAPPING = [
    ("o_orderkey", "l_orderkey"),
    ("o_orderdate", "l_shipdate"),
    ("o_custkey", cmp.NO_MAPPING),
]


def _observed_sql(table: str, columns) -> str:
    """Column names of a table with the number of values found in each."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS value_count FROM {table}" for c in columns
    )


_TEST_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
_PROD_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
COLUMN_SETS = f"""
test_names AS ({_observed_sql("lineitem", _TEST_COLUMNS)}),
old_prod AS ({_observed_sql("orders", _PROD_COLUMNS)}),
prod_names AS (SELECT CASE column_name WHEN 'o_orderkey' THEN 'l_orderkey'
  WHEN 'o_orderdate' THEN 'l_shipdate' ELSE column_name END AS column_name, value_count
  FROM old_prod),
overlap AS (SELECT coalesce(t.column_name, p.column_name) AS column_name,
  CASE WHEN p.column_name IS NULL THEN 'test only' WHEN t.column_name IS NULL THEN 'prod only'
    ELSE 'match' END AS found_in,
  t.value_count AS test_values, p.value_count AS prod_values
  FROM test_names t FULL JOIN prod_names p ON t.column_name = p.column_name)"""


def column_names(spark, sf):
    """All columns of two tables as observed: names, and how many values each holds."""
    test = observed_schema(views.read(spark, sf, "lineitem"), "t", "l")
    prod = observed_schema(views.read(spark, sf, "orders"), "p", "o")
    return test.select("column_name", "value_count"), prod.select("column_name", "value_count")


def mapping_relation(spark):
    return spark.sql(
        f"""SELECT * FROM VALUES {", ".join(str(pair) for pair in MAPPING)} AS m(old, new)"""
    )


def _mapped(spark, sf):
    test, prod = column_names(spark, sf)
    mapping = mapping_relation(spark).filter(F.col("new") != cmp.NO_MAPPING)
    renamed = prod.join(mapping, F.col("column_name") == F.col("old"), "left").select(
        F.coalesce("new", "column_name").alias("column_name"), "value_count"
    )
    return test, renamed


def _with_counts(found, test, prod):
    """Names with the number of values that each of two tables has under them."""
    return found.join(test.withColumnRenamed("value_count", "test_values"), "column_name", "left").join(
        prod.withColumnRenamed("value_count", "prod_values"), "column_name", "left"
    )


@query(
    "set_column_overlap",
    f"""WITH {COLUMN_SETS} SELECT column_name, found_in,
      coalesce(test_values, 0) + coalesce(prod_values, 0) AS n_values FROM overlap""",
)
def set_column_overlap(spark, sf):
    test, prod = _mapped(spark, sf)
    values = F.coalesce("test_values", F.lit(0)) + F.coalesce("prod_values", F.lit(0))
    return _with_counts(column_overlap(test, prod), test, prod).select(
        "column_name", "found_in", values.alias("n_values")
    )


@query("cmp_column_sets", f"WITH {COLUMN_SETS} SELECT * FROM overlap")
def cmp_column_sets(spark, sf):
    test, prod = _mapped(spark, sf)
    return _with_counts(column_overlap(test, prod), test, prod)


@query(
    "join_column_sets",
    f"""WITH {COLUMN_SETS} SELECT column_name,
      CASE WHEN found_in <> 'prod only' THEN 'yes' END AS exists_test,
      CASE WHEN found_in <> 'test only' THEN 'yes' END AS exists_prod, test_values, prod_values FROM overlap""",
)
def join_column_sets(spark, sf):
    test, prod = _mapped(spark, sf)
    test = test.withColumnRenamed("value_count", "test_values")
    prod = prod.withColumnRenamed("value_count", "prod_values")
    both = joins.outer_join_on(test, prod, ["column_name"])
    return both.select(
        "column_name",
        F.when(F.col("in_left"), F.lit("yes")).alias("exists_test"),
        F.when(F.col("in_right"), F.lit("yes")).alias("exists_prod"),
        "test_values",
        "prod_values",
    )


_REPORT = f"""{COLUMN_SETS},
report AS (SELECT column_name,
  CASE WHEN found_in <> 'prod only' THEN 'yes' ELSE 'no' END AS exists_test,
  CASE WHEN found_in <> 'test only' THEN 'yes' ELSE 'no' END AS exists_prod,
  CASE WHEN found_in = 'match' THEN 'no' ELSE 'yes' END AS variance,
  CASE column_name WHEN 'l_orderkey' THEN 'o_orderkey' WHEN 'l_shipdate' THEN 'o_orderdate' END
    AS "existing column_name prod",
  CASE found_in WHEN 'prod only' THEN 'in prod, not in test'
    WHEN 'test only' THEN 'in test, not in prod' END AS "variance reason",
  CASE WHEN found_in = 'match' THEN coalesce("existing column_name prod", column_name) END
    AS "column name prod", test_values, prod_values
  FROM overlap)"""


def _column_report(spark, sf):
    test, prod = column_names(spark, sf)
    return cmp.column_report(test, prod, mapping_relation(spark))


@query("cmp_column_report", f"WITH {_REPORT} SELECT * FROM report")
def cmp_column_report(spark, sf):
    return _with_counts(_column_report(spark, sf), *_mapped(spark, sf))


@query(
    "cmp_select_columns",
    f"""WITH {_REPORT} SELECT column_name, "column name prod" AS column_name_prod FROM report
    WHERE "column name prod" IS NOT NULL AND "existing column_name prod" IS NOT NULL
      AND NOT starts_with(column_name, 'dw_')""",
)
def cmp_select_columns(spark, sf):
    return cmp.select_columns(_column_report(spark, sf), only_mapped=True)


@query(
    "cmp_map_columns",
    """SELECT o_orderkey AS l_orderkey, o_custkey, o_orderstatus, o_totalprice,
      CAST(o_orderdate AS VARCHAR) AS l_shipdate, o_orderpriority FROM orders""",
)
def cmp_map_columns(spark, sf):
    mapped = cmp.map_columns(views.read(spark, sf, "orders"), dict(MAPPING))
    return mapped.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


# ---------------------------------------------------------------- grain, types


@query(
    "cmp_align_grain",
    """SELECT l_orderkey, l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE)
      AS l_quantity FROM lineitem GROUP BY ALL""",
)
def cmp_align_grain(spark, sf):
    lines = views.read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    return agg.sum_by_rest(lines, ["l_quantity"])


WAREHOUSE = {
    "l_orderkey": "bigint",
    "l_linenumber": "integer",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_quantity": "double precision",
    "l_extendedprice": "double precision",
    "l_returnflag": "character varying",
    "l_linestatus": "character varying",
}


@query(
    "cmp_align_types",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag,
      round(l_extendedprice / 7, 10) AS l_extendedprice FROM lineitem""",
)
def cmp_align_types(spark, sf):
    lines = views.read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        (F.col("l_extendedprice") / 7).alias("l_extendedprice"),
    )
    return cmp.align_types(lines, WAREHOUSE)


# ---------------------------------------------------------------- cells


def _cells_sql(source: str = "lineitem_source", target: str = "lineitem_target") -> str:
    """One row per differing cell of two relations with the same keys."""
    parts = " UNION ALL ".join(
        f"""SELECT {_KEYS}, row_found, '{c}' AS column_name, CAST(s_{c} AS VARCHAR) AS test_value,
          CAST(t_{c} AS VARCHAR) AS prod_value FROM paired WHERE s_{c} IS DISTINCT FROM t_{c}"""
        for c in VALUES
    )
    values = ", ".join(f"s.{c} AS s_{c}, t.{c} AS t_{c}" for c in VALUES)
    return f"""paired AS (
      SELECT {", ".join(f"coalesce(s.{k}, t.{k}) AS {k}" for k in KEYS)}, {values},
        CASE WHEN s.l_orderkey IS NULL THEN 'prod only' WHEN t.l_orderkey IS NULL THEN 'test only'
          ELSE 'both' END AS row_found
      FROM {source} s FULL JOIN {target} t ON {" AND ".join(f"s.{k} = t.{k}" for k in KEYS)}),
    cells AS ({parts})"""


def _cells(spark, sf):
    return cmp.compare_cells(
        views.lineitem_source(spark, sf), views.lineitem_target(spark, sf), KEYS
    )


@query("cmp_cell_diff", f"WITH {_cells_sql()} SELECT * FROM cells")
def cmp_cell_diff(spark, sf):
    return _cells(spark, sf)


@query(
    "cmp_cell_diff_wide",
    f"""WITH {_cells_sql()} SELECT {_KEYS}, {", ".join(
        f"CASE WHEN s_{c} IS DISTINCT FROM t_{c} THEN s_{c} END AS {c}_test, "
        f"CASE WHEN s_{c} IS DISTINCT FROM t_{c} THEN t_{c} END AS {c}_prod" for c in VALUES)}
    FROM paired WHERE row_found = 'both' AND ({" OR ".join(
        f"s_{c} IS DISTINCT FROM t_{c}" for c in VALUES)})""",
)
def cmp_cell_diff_wide(spark, sf):
    return cmp.compare_wide(
        views.lineitem_source(spark, sf), views.lineitem_target(spark, sf), KEYS, VALUES
    )


def _matrix_sql(keys: str) -> str:
    counts = [f"count(*) FILTER (column_name = '{c}')" for c in VALUES]
    named = ", ".join(f"{n} AS {c}" for n, c in zip(counts, VALUES))
    total = " + ".join(counts)
    return f'SELECT {keys}, {named}, {total} AS "Total Variances" FROM cells GROUP BY {keys}'


@query("cmp_variance_matrix", f"WITH {_cells_sql()} {_matrix_sql('l_orderkey')}")
def cmp_variance_matrix(spark, sf):
    return agg.variance_matrix(_cells(spark, sf), POP_KEYS, VALUES)


@query(
    "agg_variance_matrix",
    f"WITH {_cells_sql()} {_matrix_sql('l_suppkey, row_found')}",
)
def agg_variance_matrix(spark, sf):
    return agg.variance_matrix(_cells(spark, sf), ["l_suppkey", "row_found"], VALUES)


@query(
    "cmp_variance_detail",
    f"""WITH {_cells_sql()} SELECT l_orderkey, test_value AS l_returnflag_test,
      prod_value AS l_returnflag_prod FROM cells WHERE column_name = 'l_returnflag'""",
)
def cmp_variance_detail(spark, sf):
    return agg.variance_detail(_cells(spark, sf), POP_KEYS, "l_returnflag")


# Line items of an order by position. Prod has one column more, one named differently,
# and lacks some rows.
_TIDY_COLUMNS = [
    ("l_linenumber", "l_linenumber", "INTEGER"),
    ("l_partkey", "l_partkey", "BIGINT"),
    ("l_suppkey", "l_suppkey", "BIGINT"),
    ("l_returnflag", "flag", None),
    ("l_quantity", "l_quantity", "DOUBLE"),
    (None, "l_linestatus", None),
]


def _tidy_sql(population: str | None) -> str:
    chosen = f"WHERE l_orderkey IN ({population})" if population else ""
    numbered = """row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey) AS row_num"""

    def cell(i: int, test: str | None, prod: str | None, kind: str | None) -> str:
        label = test if test == prod else f"{test} / {prod}" if test else prod
        t = (
            f"CASE WHEN t_row IS NULL THEN 'ROW MISSING IN TEST' ELSE CAST(t_{test} AS VARCHAR) END"
            if test
            else "'COLUMN MISSING IN TEST'"
        )
        column = "l_returnflag" if prod == "flag" else prod
        p = (
            "CASE WHEN p_row IS NULL THEN 'ROW MISSING IN PROD' "
            f"ELSE CAST(p_{column} AS VARCHAR) END"
        )
        gap = (
            f"round(CAST(t_{test} AS DOUBLE) - CAST(p_{column} AS DOUBLE), 10)"
            if kind
            else "CAST(NULL AS DOUBLE)"
        )
        return f"""SELECT l_orderkey, CAST(row_num AS VARCHAR) AS row_num, {i} AS column_position,
          '{label}' AS column_name, {t} AS test_value, {p} AS prod_value, {gap} AS variance,
          CASE WHEN coalesce({gap} = 0, {t} IS NOT DISTINCT FROM {p}) THEN 'Y' ELSE 'N' END AS match
          FROM paired"""

    columns = "l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, l_linestatus".split(", ")
    cells = " UNION ALL ".join(
        cell(i, *spec) for i, spec in enumerate(_TIDY_COLUMNS, start=1)
    )
    return f"""s AS (SELECT *, {numbered} FROM lineitem_source {chosen}),
    t AS (SELECT *, {numbered} FROM lineitem_target {chosen}),
    paired AS (
      SELECT coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey,
        coalesce(s.row_num, t.row_num) AS row_num, s.row_num AS t_row, t.row_num AS p_row,
        {", ".join(f"s.{c} AS t_{c}, t.{c} AS p_{c}" for c in columns)}
      FROM s FULL JOIN t ON s.l_orderkey = t.l_orderkey AND s.row_num = t.row_num),
    counts AS (SELECT l_orderkey, count(t_row) AS t, count(p_row) AS p FROM paired GROUP BY 1),
    tidy AS ({cells}
      UNION ALL SELECT l_orderkey, 'ALL', NULL, '__ROW_COUNT__', CAST(t AS VARCHAR),
        CAST(p AS VARCHAR), CAST(t - p AS DOUBLE), 'N' FROM counts WHERE t <> p
      UNION ALL SELECT l_orderkey, 'ALL', NULL, '__COLUMN_COUNT__', '5', '6', -1.0::DOUBLE, 'N'
        FROM counts)"""


def _tidy_sides(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    test = views.lineitem_source(spark, sf, POP_KEYS).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"
    )
    prod = views.lineitem_target(spark, sf, POP_KEYS).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_returnflag").alias("flag"),
        "l_quantity",
        "l_linestatus",
    )
    return test, prod, order


_SAMPLE_1000 = _SAMPLE.replace("LIMIT 50", "LIMIT 1000")


def _population(spark, sf, size):
    sample = joins.sample_population(views.read(spark, sf, "orders"), ["o_orderkey"], size)
    return sample.withColumnRenamed("o_orderkey", "l_orderkey")


def _all_orders(spark, sf):
    return views.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))


@query("cmp_tidy", f"WITH {_tidy_sql(None)} SELECT * FROM tidy")
def cmp_tidy(spark, sf):
    test, prod, order = _tidy_sides(spark, sf)
    return cmp.compare_tidy(test, prod, POP_KEYS, order, small_groups=True)


@query(
    "agg_run_summary",
    f"""WITH {_tidy_sql(None)} SELECT o_orderkey AS l_orderkey,
      CASE WHEN count(*) FILTER (column_name = '__ROW_COUNT__' AND test_value = '0') > 0
          THEN 'missing in test'
        WHEN count(*) FILTER (column_name = '__ROW_COUNT__' AND prod_value = '0') > 0
          THEN 'missing in prod'
        WHEN count(match) = 0 THEN 'missing in both' ELSE 'OK' END AS status,
      count(*) FILTER (match = 'N') AS mismatches
    FROM orders LEFT JOIN tidy ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def agg_run_summary(spark, sf):
    test, prod, order = _tidy_sides(spark, sf)
    run = recon.positional_run(test, prod, _all_orders(spark, sf), POP_KEYS, order, small_groups=True)
    return run["summary"]


@query(
    "cmp_population",
    f"""WITH chosen_s AS (SELECT * FROM lineitem_source WHERE l_orderkey IN ({_SAMPLE_1000})),
      chosen_t AS (SELECT * FROM lineitem_target WHERE l_orderkey IN ({_SAMPLE_1000})),
      {_cells_sql("chosen_s", "chosen_t")} SELECT * FROM cells""",
)
def cmp_population(spark, sf):
    run = recon.compare_environments(
        views.lineitem_source(spark, sf),
        views.lineitem_target(spark, sf).withColumnsRenamed({"l_quantity": "qty", "l_suppkey": "s"}),
        KEYS,
        _population(spark, sf, 1000),
        POP_KEYS,
        {"qty": "l_quantity", "s": "l_suppkey"},
        WAREHOUSE,
        ["l_quantity"],
    )
    return run["variance"]


_MATRIX = ", ".join(f"count(*) FILTER (column_name = '{c}') AS {c}" for c in sorted(VALUES))


@query(
    "cmp_population_matrix",
    f"""WITH {_cells_sql()} SELECT o_orderkey AS l_orderkey, {_MATRIX},
      count(column_name) AS "Total Variances"
    FROM orders LEFT JOIN cells ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def cmp_population_matrix(spark, sf):
    run = recon.compare_environments(
        views.lineitem_source(spark, sf, POP_KEYS),
        views.lineitem_target(spark, sf, POP_KEYS),
        KEYS,
        _all_orders(spark, sf),
        POP_KEYS,
        {},
        WAREHOUSE,
        placed_by=POP_KEYS,
    )
    return run["matrix"]


def _environments(spark, sf):
    """Source and target as texts, with some values and keys that are no numbers."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    price, key = F.col("l_extendedprice").cast("string"), order.cast("string")
    test = views.lineitem_source(spark, sf, POP_KEYS).withColumns(
        {
            "l_orderkey": F.when(order % 1009 == 0, F.concat(F.lit("order "), key)).otherwise(key),
            "l_extendedprice": F.when((order + line) % 97 == 0, F.lit("n/a")).otherwise(price),
        }
    )
    prod = views.lineitem_target(spark, sf, POP_KEYS).withColumns(
        {
            "l_linenumber": F.when(order % 503 == 0, F.lit("first")).otherwise(line.cast("string")),
            "l_extendedprice": F.when((order + line) % 89 == 0, F.lit("")).otherwise(price),
        }
    )
    prod = prod.withColumnRenamed("l_extendedprice", "price")
    return recon.compare_environments(
        test, prod, KEYS, _all_orders(spark, sf), POP_KEYS, {"price": "l_extendedprice"}, WAREHOUSE, only_mapped=True,
        placed_by=POP_KEYS,
    )


def _note(side: str, column: str | None, value: str, note: str, source: str, keys: dict[str, str | None]) -> str:
    """Notes of one kind, from rows of ``source``; ``keys`` replaces keys."""
    listed = ", ".join(f"CAST({keys.get(k, k)} AS BIGINT) AS {k}" for k in KEYS)
    name = f"'{column}'" if column else "NULL"
    return f"SELECT {listed}, '{side}' AS side, {name} AS column_name, {value} AS value, '{note}' AS note FROM {source}"


_NO_KEYS = {"l_orderkey": "o_orderkey"} | dict.fromkeys(KEYS[1:], "NULL")
_TEST_ROWS = "lineitem_source WHERE l_orderkey % 1009 <> 0"
_PROD_ROWS = "lineitem_target WHERE l_orderkey % 503 <> 0"


@query(
    "cmp_notes",
    " UNION ALL ".join(
        [
            _note(
                "test", "l_orderkey", "'order ' || l_orderkey", cmp.BAD_KEY,
                "lineitem_source WHERE l_orderkey % 1009 = 0", {"l_orderkey": "NULL"},
            ),
            _note(
                "prod", "l_linenumber", "'first'", cmp.BAD_KEY,
                "lineitem_target WHERE l_orderkey % 503 = 0", {"l_linenumber": "NULL"},
            ),
            _note(
                "test", "l_extendedprice", "'n/a'", cmp.BAD_VALUE,
                _TEST_ROWS + " AND (l_orderkey + l_linenumber) % 97 = 0", {},
            ),
            _note(
                "prod", "l_extendedprice", "''", cmp.BAD_VALUE,
                _PROD_ROWS + " AND (l_orderkey + l_linenumber) % 89 = 0", {},
            ),
            _note(
                "test", None, "NULL", cmp.NO_ROWS,
                f"orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM {_TEST_ROWS})", _NO_KEYS,
            ),
            _note(
                "prod", None, "NULL", cmp.NO_ROWS,
                f"orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM {_PROD_ROWS})", _NO_KEYS,
            ),
        ]
    ),
)
def cmp_notes(spark, sf):
    return _environments(spark, sf)["notes"]


@query(
    "cmp_environment_columns",
    """SELECT column_name, 'yes' AS exists_test, 'yes' AS exists_prod, 'no' AS variance,
      CASE column_name WHEN 'l_extendedprice' THEN 'price' END AS "existing column_name prod",
      CAST(NULL AS VARCHAR) AS "variance reason",
      CASE column_name WHEN 'l_extendedprice' THEN 'price' ELSE column_name END AS "column name prod"
    FROM (DESCRIBE lineitem_source)""",
)
def cmp_environment_columns(spark, sf):
    return _environments(spark, sf)["columns"]


@query(
    "cmp_environment_cells",
    f"""WITH t AS (SELECT * REPLACE (CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN 'n/a'
        ELSE CAST(l_extendedprice AS VARCHAR) END AS l_extendedprice) FROM {_TEST_ROWS}),
      p AS (SELECT * REPLACE (CASE WHEN (l_orderkey + l_linenumber) % 89 = 0 THEN ''
        ELSE CAST(l_extendedprice AS VARCHAR) END AS l_extendedprice) FROM {_PROD_ROWS}),
      {_cells_sql("t", "p")} SELECT * FROM cells WHERE column_name = 'l_extendedprice'""",
)
def cmp_environment_cells(spark, sf):
    return _environments(spark, sf)["variance"]


# ---------------------------------------------------------------- source against target


def _stack_sql() -> str:
    numbers = ["l_quantity", "l_extendedprice"]

    def gap(c: str) -> str:
        if c not in numbers:
            return f"""CASE WHEN row_found = 'both' AND s_{c} IS NOT DISTINCT FROM t_{c}
              THEN 'MATCH' ELSE 'MISMATCH' END"""
        text = f"CAST(CAST(s_{c} - t_{c} AS DECIMAL(38,10)) AS VARCHAR)"
        return f"""CASE WHEN row_found <> 'both' THEN 'MISMATCH'
          WHEN s_{c} = t_{c} OR (s_{c} IS NULL AND t_{c} IS NULL) THEN '0'
          WHEN s_{c} IS NULL OR t_{c} IS NULL THEN 'MISMATCH'
          ELSE rtrim(rtrim({text}, '0'), '.') END"""

    def side(tag: str, prefix: str, other: str) -> str:
        values = ", ".join(f"CAST({prefix}_{c} AS VARCHAR) AS {c}" for c in VALUES)
        return (
            f"SELECT {_KEYS}, '{tag}' AS row_source, {values} FROM paired "
            f"WHERE row_found <> '{other} only'"
        )

    gaps = ", ".join(f"{gap(c)} AS {c}" for c in VALUES)
    return f"""{_cells_sql()},
    stacked AS ({side("SOURCE", "s", "prod")} UNION ALL {side("TARGET", "t", "test")}
      UNION ALL SELECT {_KEYS}, 'VARIANCE', {gaps} FROM paired),
    flagged AS (SELECT *, CASE WHEN {" AND ".join(f"{c} IN ('0', 'MATCH')" for c in VALUES)}
      THEN 'no' ELSE 'yes' END AS is_variance FROM stacked WHERE row_source = 'VARIANCE')"""


def _stacked(spark, sf):
    return cmp.stack_sides(
        views.lineitem_source(spark, sf, POP_KEYS), views.lineitem_target(spark, sf, POP_KEYS), KEYS, placed_by=POP_KEYS
    )


@query("cmp_s2t_stack", f"WITH {_stack_sql()} SELECT * FROM stacked")
def cmp_s2t_stack(spark, sf):
    return _stacked(spark, sf)


@query("cmp_s2t_flag", f"WITH {_stack_sql()} SELECT * FROM flagged")
def cmp_s2t_flag(spark, sf):
    return cmp.flag_variance(_stacked(spark, sf), exempt=KEYS)


@query(
    "cmp_s2t_summary",
    f"""WITH {_stack_sql()} SELECT l_orderkey, l_suppkey, count(*) AS test_count,
      count(*) FILTER (is_variance = 'yes') AS variance_count FROM flagged GROUP BY ALL""",
)
def cmp_s2t_summary(spark, sf):
    flagged = cmp.flag_variance(_stacked(spark, sf), exempt=KEYS)
    return agg.variance_counts(flagged, ["l_orderkey", "l_suppkey"])


@query(
    "agg_variance_summary",
    f"""WITH {_stack_sql()} SELECT l_orderkey, count(*) AS test_count,
      count(*) FILTER (is_variance = 'yes') AS variance_count FROM flagged GROUP BY ALL""",
)
def agg_variance_summary(spark, sf):
    run = recon.source_against_target(
        views.lineitem_source(spark, sf, POP_KEYS),
        views.lineitem_target(spark, sf, POP_KEYS),
        KEYS,
        _all_orders(spark, sf),
        POP_KEYS,
        exempt=KEYS,
        placed_by=POP_KEYS,
    )
    return run["summary"]


# ---------------------------------------------------------------- extracts

# Two extracts of customers: rows of one side only, rates missing on a side, texts lost.
EXTRACTS = """
chosen AS (SELECT c_custkey AS prop_cd,
  CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS brand_cd,
  CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS rate
  FROM customer WHERE c_custkey % 9 <> 0),
tabled AS (SELECT c_custkey AS prop_cd,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS brand_cd,
  CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal + 50 END
    AS rate
  FROM customer WHERE c_custkey % 11 <> 0)"""


def extracts(spark, sf):
    key, segment, balance = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    customer = views.read(spark, sf, "customer")
    chosen = customer.filter(key % 9 != 0).select(
        key.alias("prop_cd"),
        F.when(key % 6 != 0, segment).alias("brand_cd"),
        F.when(key % 10 != 0, balance).alias("rate"),
    )
    tabled = customer.filter(key % 11 != 0).select(
        key.alias("prop_cd"),
        F.when(key % 4 != 0, segment).alias("brand_cd"),
        F.when(key % 8 == 0, F.lit(None).cast("double"))
        .when(key % 3 == 0, F.lit(0.0))
        .otherwise(balance + 50)
        .alias("rate"),
    )
    return chosen, tabled


def _extract_sql(missing_from: str) -> str:
    pct = null_aware_sql(missing_from)
    return f"""WITH {EXTRACTS}, both_sides AS (
      SELECT prop_cd, s.brand_cd AS brand_cd_select, t.brand_cd AS brand_cd_table,
        s.rate AS a, t.rate AS b FROM chosen s FULL JOIN tabled t USING (prop_cd))
    SELECT prop_cd, brand_cd_select, brand_cd_table, a AS rate_select, b AS rate_table,
      CASE WHEN (brand_cd_select IS NULL) <> (brand_cd_table IS NULL) THEN 'variance' END
        AS brand_cd_variance,
      round({pct}, 6) AS "rate_var %" FROM both_sides"""


def _compared(spark, sf, missing_from):
    compared = cmp.compare_extracts(
        *extracts(spark, sf), ["prop_cd"], ["brand_cd"], ["rate"], missing_from
    )
    return compared.withColumn("rate_var %", F.round("rate_var %", 6))


@query("cmp_extracts", _extract_sql("1.0::DOUBLE"))
def cmp_extracts(spark, sf):
    return _compared(spark, sf, "one")


@query("cmp_extracts_alt", _extract_sql("b * -1"))
def cmp_extracts_alt(spark, sf):
    return _compared(spark, sf, "neg_to")


@query(
    "cmp_preconditions",
    f"""WITH {EXTRACTS} SELECT 'select' AS side, count(*) AS n, count(DISTINCT prop_cd) AS keys
    FROM chosen UNION ALL SELECT 'table', count(*), count(DISTINCT prop_cd) FROM tabled""",
)
def cmp_preconditions(spark, sf):
    chosen, tabled = extracts(spark, sf)
    cmp.check_extracts(chosen, tabled, ["prop_cd"])
    cmp.check_unique(chosen, ["prop_cd"], "select")
    cmp.check_unique(tabled, ["prop_cd"], "table")
    return union_all(
        [
            df.agg(
                F.lit(side).alias("side"),
                F.count(F.lit(1)).alias("n"),
                F.count_distinct("prop_cd").alias("keys"),
            )
            for side, df in (("select", chosen), ("table", tabled))
        ]
    )


# ---------------------------------------------------------------- specification

SPEC = [
    ("sales", "orders", "o_orderkey", "bigint", None),
    ("sales", "orders", "o_orderstatus", "varchar", 1),
    ("sales", "orders", "o_orderpriority", "varchar", 99),
    ("sales", "orders", "o_orderdate", "timestamp", None),
    ("sales", "lines", "o_totalprice", "double precision", None),
    ("sales", "orders", "o_no_such_column", "date", None),
]
_ORDERS_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "character varying",
    "o_totalprice": "double precision",
    "o_orderdate": "timestamp without time zone",
    "o_orderpriority": "character varying",
}


def _catalog_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT 'sales' AS schema, 'orders' AS object, '{c}' AS column_name, '{t}' AS data_type, "
        + (f"max(length({c}))" if t == "character varying" else "CAST(NULL AS BIGINT)")
        + f" AS length FROM orders HAVING count({c}) >= 0"
        for c, t in _ORDERS_TYPES.items()
    )


_SPEC_ROWS = ", ".join(
    "(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in SPEC
)


def spec_and_catalog(spark, sf):
    spec = spark.sql(
        f"""SELECT * FROM VALUES {_SPEC_ROWS}
        AS s(schema, object, column_name, data_type, length)"""
    )
    catalog = observed_schema(views.read(spark, sf, "orders"), "sales", "orders")
    return spec, catalog.drop("ordinal", "value_count")


SPEC_CTES = f"""
spec AS (SELECT * FROM (VALUES {_SPEC_ROWS}) AS s(schema, object, column_name, data_type, length)),
catalog AS ({_catalog_sql()}),
checked AS (
  SELECT coalesce(s.column_name, c.column_name) AS column_name, s.schema AS schema_spec,
    c.schema AS schema_target, s.object AS object_spec, c.object AS object_target,
    CAST(s.length AS INTEGER) AS length_spec, CAST(c.length AS INTEGER) AS length_target,
    s.data_type AS data_type_spec, c.data_type AS data_type_target,
    CASE c.data_type WHEN 'character varying' THEN 'varchar'
      WHEN 'timestamp without time zone' THEN 'timestamp' ELSE c.data_type END
      AS data_type_target_adjusted,
    CASE WHEN s.object IS NOT DISTINCT FROM c.object THEN 'good' ELSE 'bad' END
      AS object_validation,
    CASE WHEN s.length IS NOT DISTINCT FROM c.length THEN 'good' ELSE 'bad' END
      AS length_validation,
    CASE WHEN s.data_type IS NOT DISTINCT FROM data_type_target_adjusted THEN 'good'
      ELSE 'bad' END AS data_type_validation
  FROM spec s FULL JOIN catalog c ON s.column_name = c.column_name)"""


@query(
    "cmp_spec_schema",
    f"""WITH {SPEC_CTES} SELECT *, CASE WHEN object_validation = 'good'
      AND length_validation = 'good' AND data_type_validation = 'good' THEN 'good' ELSE 'bad' END
      AS total_validation FROM checked""",
)
def cmp_spec_schema(spark, sf):
    return cmp.compare_spec(*spec_and_catalog(spark, sf))


@query(
    "join_spec_schema",
    f"""WITH {SPEC_CTES} SELECT column_name, data_type_spec, data_type_target FROM checked""",
)
def join_spec_schema(spark, sf):
    both = joins.outer_join_on(
        *spec_and_catalog(spark, sf), ["column_name"], ("_spec", "_target")
    )
    return both.select("column_name", "data_type_spec", "data_type_target")
