"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgeframe import views
from lodgeframe.catalog.registry import query
from lodgeframe.catalog.revenue import CANDIDATES, FACTORS, TXN, as_text, stay_sql
from lodgeframe.operators import joins
from lodgeframe.operators import revenue as rev
from lodgeframe.operators.sets import number_rows
from lodgeframe.views import END, START

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(KEYS)


@query(
    "join_current_version",
    """SELECT d.stay_id, d.checkout_detail_key, d.prop_cd FROM checkout_curr c
    JOIN checkout_detail d ON d.stay_id = c.stay_id
      AND d.checkout_detail_key = c.checkout_detail_key""",
)
def join_current_version(spark, sf):
    current = rev.current_details(
        views.checkout_curr(spark, sf), views.checkout_detail(spark, sf)
    )
    return current.select("stay_id", "checkout_detail_key", "prop_cd")


@query(
    "join_booking",
    f"WITH {FACTORS} SELECT stay_id, CAST(room_nights AS INTEGER) AS room_nights FROM booked",
)
def join_booking(spark, sf):
    return rev.stay_factors(views.stay_tables(spark, sf), START, END).select(
        "stay_id", "room_nights"
    )


def _inside(spark, sf):
    tables = views.stay_tables(spark, sf)
    bounds = rev.extract_bounds(rev.candidate_stays(tables, START, END))
    return rev.within_bounds(tables.transactions, bounds)


@query(
    "join_extract_window",
    f"""WITH {CANDIDATES},{TXN} SELECT stay_id, folio_id, trans_id, charge_category,
      CAST(extract_last_update_dtm AS VARCHAR) AS extract_last_update_dtm FROM inside""",
)
def join_extract_window(spark, sf):
    names = ["stay_id", "folio_id", "trans_id", "charge_category", "extract_last_update_dtm"]
    return as_text(_inside(spark, sf).select(*names), "extract_last_update_dtm")


@query(
    "join_primary_category",
    f"""WITH {CANDIDATES},{TXN} SELECT t.stay_id, t.folio_id, t.trans_id, t.charge_category,
      p.primary_charge_category FROM inside t LEFT JOIN primary_cat p ON t.stay_id = p.stay_id
      AND t.folio_id = p.folio_id AND t.trans_id = p.trans_id
    WHERE t.charge_category = 'room'""",
)
def join_primary_category(spark, sf):
    inside = _inside(spark, sf)
    keys = ["stay_id", "folio_id", "trans_id"]
    return (
        inside.filter(rev.is_v1("room"))
        .select(*keys, "charge_category")
        .join(rev.primary_category(inside), keys, "left")
    )


@query(
    "join_version_ts",
    f"""WITH {stay_sql('room')} SELECT prop_cd, stay_id, folio_id, trans_id,
      CAST(ledger_entry_amt AS DOUBLE) AS ledger_entry_amt FROM detail""",
)
def join_version_ts(spark, sf):
    stays = rev.stay_factors(views.stay_tables(spark, sf), START, END)
    rows = _inside(spark, sf).filter(rev.is_v1("room"))
    return rows.join(stays, ["stay_id", "extract_last_update_dtm"]).select(
        "prop_cd",
        "stay_id",
        "folio_id",
        "trans_id",
        F.col("ledger_entry_amt").cast("double").alias("ledger_entry_amt"),
    )


@query(
    "join_fx",
    """SELECT stay_id, currency_cd, exchange_rate AS plan_exchange_rate
    FROM checkout_detail LEFT JOIN (SELECT * FROM fx_rates
      WHERE conversion_type = 'Plan Exchange Rates' AND to_currency = 'USD') AS r
    ON currency_cd = from_currency""",
)
def join_fx(spark, sf):
    detail = views.checkout_detail(spark, sf).select("stay_id", "currency_cd")
    rates = rev.plan_rates(views.fx_rates(spark))
    return detail.join(rates, F.col("currency_cd") == F.col("from_currency"), "left").drop(
        "from_currency"
    )


# Each side lacks some customers; some customers' segment is missing on both sides.
_SIDES = """
sides AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment,
  c_acctbal AS amount FROM customer),
a AS (SELECT * FROM sides WHERE id % 7 <> 0),
b AS (SELECT id, segment, amount + 1 AS amount FROM sides WHERE id % 4 <> 0)"""


def _sides(spark, sf):
    key = F.col("c_custkey")
    sides = views.read(spark, sf, "customer").select(
        key.alias("id"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("segment"),
        F.col("c_acctbal").alias("amount"),
    )
    a = sides.filter(F.col("id") % 7 != 0)
    b = sides.filter(F.col("id") % 4 != 0).withColumn("amount", F.col("amount") + 1)
    return a, b


@query(
    "join_outer_versions",
    f"""WITH {_SIDES} SELECT coalesce(a.id, b.id) AS id, coalesce(a.segment, b.segment) AS segment,
      round(a.amount, 2) AS "amount v2", round(b.amount, 2) AS "amount v1"
    FROM a FULL JOIN b ON a.id IS NOT DISTINCT FROM b.id
      AND a.segment IS NOT DISTINCT FROM b.segment""",
)
def join_outer_versions(spark, sf):
    a, b = _sides(spark, sf)
    joined = joins.outer_join_keys(a, b, ["id", "segment"], (" v2", " v1"))
    return joined.select(
        "id",
        "segment",
        F.round("amount v2", 2).alias("amount v2"),
        F.round("amount v1", 2).alias("amount v1"),
    )


@query(
    "join_outer_nway",
    """WITH o AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1),
    e AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1),
    c AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS n FROM customer),
    ids AS (SELECT id FROM o UNION SELECT id FROM e UNION SELECT id FROM c)
    SELECT id, o.n AS n_orders, e.n AS n_events, c.n AS n_customers
    FROM ids LEFT JOIN o USING (id) LEFT JOIN e USING (id) LEFT JOIN c USING (id)""",
)
def join_outer_nway(spark, sf):
    def counted(table, key):
        return (
            views.read(spark, sf, table)
            .groupBy(F.col(key).alias("id"))
            .agg(F.count(F.lit(1)).alias("n"))
        )

    customers = views.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("n")
    )
    frames = {
        "orders": counted("orders", "o_custkey"),
        "events": counted("events", "user_id"),
        "customers": customers,
    }
    return joins.outer_join_all(frames, "id")


@query(
    "join_hierarchy",
    """SELECT stay_id, prop_cd, country_cd, country_desc, op_area_level2_desc
    FROM checkout_detail LEFT JOIN prop_hierarchy USING (prop_cd)""",
)
def join_hierarchy(spark, sf):
    detail = views.checkout_detail(spark, sf).select("stay_id", "prop_cd")
    return detail.join(views.prop_hierarchy(spark, sf), "prop_cd", "left")


@query(
    "join_outer_grain",
    f"""SELECT {_KEYS}, s.l_quantity AS l_quantity_select, t.l_quantity AS l_quantity_table,
      s.l_returnflag AS l_returnflag_select, t.l_returnflag AS l_returnflag_table
    FROM lineitem_source s FULL JOIN lineitem_target t USING ({_KEYS})""",
)
def join_outer_grain(spark, sf):
    columns = [*KEYS, "l_quantity", "l_returnflag"]
    joined = joins.outer_join_keys(
        views.lineitem_source(spark, sf).select(*columns),
        views.lineitem_target(spark, sf).select(*columns),
        KEYS,
        ("_select", "_table"),
    )
    return joined.drop("in_left", "in_right")


@query(
    "join_overwrite",
    """WITH o AS (SELECT DISTINCT p_brand AS filename, p_type AS field,
      'decimal' AS data_type_overwrite FROM part WHERE p_size > 45)
    SELECT p_partkey, data_type_overwrite
    FROM part LEFT JOIN o ON p_brand = filename AND p_type = field""",
)
def join_overwrite(spark, sf):
    part = views.read(spark, sf, "part")
    overwrite = (
        part.filter("p_size > 45")
        .select("p_brand", "p_type")
        .distinct()
        .withColumn("data_type_overwrite", F.lit("decimal"))
    )
    return part.join(overwrite, ["p_brand", "p_type"], "left").select(
        "p_partkey", "data_type_overwrite"
    )


@query(
    "join_dict_lookup",
    """WITH last AS (
      SELECT lower(p_name) AS name, max_by(p_brand, p_partkey) AS brand,
        max_by(p_size, p_partkey) AS size
      FROM part GROUP BY 1)
    SELECT p_partkey, brand AS dict_brand, size AS dict_size
    FROM part JOIN last ON lower(p_name) = name""",
)
def join_dict_lookup(spark, sf):
    part = views.read(spark, sf, "part")
    fields = part.select("p_partkey", F.upper("p_name").alias("field"))
    found = joins.lookup_last(
        fields, part, "field", "p_name",
        {"p_brand": "dict_brand", "p_size": "dict_size"}, ["p_partkey"],
    )
    return found.drop("field")


@query(
    "join_positional",
    f"""WITH s AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey) AS row_num FROM lineitem_source),
      t AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey) AS row_num FROM lineitem_target)
    SELECT l_orderkey, row_num, s.l_quantity AS l_quantity_test, t.l_quantity AS l_quantity_prod
    FROM s FULL JOIN t USING (l_orderkey, row_num)""",
)
def join_positional(spark, sf):
    def numbered(df):
        rows = df.select(*KEYS, "l_quantity")
        rows = number_rows(rows, KEYS[1:], partition_by=["l_orderkey"], small_groups=True)
        return rows.select("l_orderkey", "row_num", "l_quantity")

    return joins.outer_join_keys(
        numbered(views.lineitem_source(spark, sf, ["l_orderkey"])),
        numbered(views.lineitem_target(spark, sf, ["l_orderkey"])),
        ["l_orderkey", "row_num"],
        ("_test", "_prod"),
        placed_by=["l_orderkey"],
    ).drop("in_left", "in_right")


_SAMPLE = "SELECT o_orderkey FROM orders ORDER BY md5('|' || CAST(o_orderkey AS VARCHAR)) LIMIT 50"


@query(
    "join_semi_population",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    WHERE l_orderkey IN ({_SAMPLE})""",
)
def join_semi_population(spark, sf):
    orders = views.read(spark, sf, "orders")
    population = joins.sample_population(orders, ["o_orderkey"], 50)
    lines = views.read(spark, sf, "lineitem").select(*KEYS, "l_quantity")
    return joins.only_in(
        lines, population.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"]
    )


@query("sample_population", _SAMPLE)
def sample_population(spark, sf):
    return joins.sample_population(views.read(spark, sf, "orders"), ["o_orderkey"], 50)
