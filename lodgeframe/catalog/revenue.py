"""Queries of revenue recognition."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgeframe import views
from lodgeframe.catalog.registry import query
from lodgeframe.functions import dates
from lodgeframe.operators import revenue as rev
from lodgeframe.views import END, START

_S, _E = f"DATE '{START}'", f"DATE '{END}'"

# The statement chain of revenue recognition, one step per name.
CANDIDATES = f"""
candidates AS (
  SELECT d.* FROM checkout_curr c JOIN checkout_detail d
    ON d.stay_id = c.stay_id AND d.checkout_detail_key = c.checkout_detail_key
  WHERE d.arrival_dt <= {_E} AND d.departure_dt >= {_S}
    AND d.prop_stay_status NOT IN ('N', 'X'))"""
POPULATION = f"""{CANDIDATES},
pop AS (
  SELECT *, greatest(date_diff('day', arrival_dt, {_S}), 0) AS days_before,
    greatest(date_diff('day', {_E} + 1, departure_dt), 0) AS days_after
  FROM candidates
  WHERE departure_dt >= {_S} + 1 OR (arrival_dt = {_S} AND departure_dt = {_S}))"""
FACTORS = f"""{POPULATION},
booked AS (
  SELECT p.*, s.room_cnt * date_diff('day', s.arrival_dt, s.departure_dt) AS room_nights
  FROM pop p LEFT JOIN stay_curr_booking b ON p.stay_id = b.stay_id
    JOIN stay s ON b.stay_id = s.stay_id AND b.stay_key = s.stay_key),
factors AS (
  SELECT *, CASE WHEN room_nights >= 1
    THEN 1 - (days_before + days_after) / CAST(room_nights AS DOUBLE)
    ELSE 1 END AS factor
  FROM booked)"""
TXN = """
bounds AS (SELECT min(extract_last_update_dtm) AS lo, max(extract_last_update_dtm) AS hi
  FROM candidates),
inside AS (SELECT t.* FROM checkout_transaction t, bounds
  WHERE extract_last_update_dtm BETWEEN lo AND hi),
primary_cat AS (
  SELECT stay_id, folio_id, trans_id, max(charge_category) AS primary_charge_category
  FROM inside
  WHERE charge_category <> '' AND posting_type = 'P' AND trans_id IS NOT NULL
    AND ledger_entry_amt <> 0
  GROUP BY ALL)"""
_REVENUE_TYPES = "entry_type IN ('CHARGE', 'ADJUST', 'ALLOWE')"


def stay_sql(category: str, factors: str = FACTORS) -> str:
    return f"""{factors},{TXN},
detail AS (
  SELECT f.prop_cd, f.stay_id, f.currency_cd, f.room_nights, f.factor,
    t.folio_id, t.trans_folio_id, t.trans_id, t.charge_category, t.posting_type, t.entry_type,
    t.acctg_category, t.charge_routed_ind, t.ledger_entry_amt, p.primary_charge_category
  FROM factors f JOIN inside t ON f.stay_id = t.stay_id
      AND f.extract_last_update_dtm = t.extract_last_update_dtm
    LEFT JOIN primary_cat p ON t.stay_id = p.stay_id AND t.folio_id = p.folio_id
      AND t.trans_id = p.trans_id
  WHERE t.charge_category = '{category}'),
flags AS (
  SELECT *, folio_id = trans_folio_id AND ledger_entry_amt <> 0 AS own,
    coalesce({_REVENUE_TYPES} AND posting_type = 'P' AND charge_routed_ind <> true, false) AS is2,
    coalesce({_REVENUE_TYPES} AND posting_type = 'P', false) AS is3,
    coalesce(own AND primary_charge_category = charge_category AND {_REVENUE_TYPES}, false) AS f1,
    coalesce(own AND primary_charge_category = 'tax' AND charge_category = 'tax'
      AND entry_type = 'ALLOWE', false) AS f2,
    coalesce(own AND charge_category = 'room' AND acctg_category = 'RX', false) AS f3
  FROM detail),
stays AS (
  SELECT prop_cd, stay_id, currency_cd, room_nights, factor,
    sum(ledger_entry_amt) AS lc_v1,
    sum(CASE WHEN is2 THEN ledger_entry_amt ELSE 0 END) AS lc_v2,
    sum(CASE WHEN is3 THEN ledger_entry_amt ELSE 0 END) AS lc_v3,
    sum(CASE WHEN f1 THEN ledger_entry_amt ELSE 0 END) AS rev_filter_1,
    sum(CASE WHEN f2 THEN ledger_entry_amt ELSE 0 END) AS rev_filter_2,
    sum(CASE WHEN f3 THEN ledger_entry_amt ELSE 0 END) AS rev_filter_3,
    rev_filter_1 + rev_filter_2 + rev_filter_3 AS lc_v4
  FROM flags GROUP BY prop_cd, stay_id, currency_cd, room_nights, factor)"""


def prop_sql(version: str, name: str = "props", source: str = "stays") -> str:
    """One property-level extract from the stay level."""
    return f"""
{name}_local AS (
  SELECT prop_cd, currency_cd, sum(CAST(room_nights * factor AS DECIMAL(28,6))) AS nights,
    sum(CAST(CAST(lc_{version} AS DOUBLE) * factor AS DECIMAL(28,6))) AS lc
  FROM {source} WHERE lc_{version} <> 0 GROUP BY prop_cd, currency_cd),
{name} AS (
  SELECT prop_cd, CAST(round(sum(nights), 0) AS DOUBLE) AS room_nights,
    CAST(round(sum(CAST(CAST(lc AS DOUBLE) * exchange_rate AS DECIMAL(28,6))), 2) AS DOUBLE)
      AS room_rev_usd
  FROM {name}_local LEFT JOIN (SELECT * FROM fx_rates
      WHERE conversion_type = 'Plan Exchange Rates' AND to_currency = 'USD') AS r
    ON currency_cd = r.from_currency
  GROUP BY prop_cd)"""


@query(
    "rev_prop_revenue",
    f"WITH {stay_sql('room')},{prop_sql('v4')} SELECT prop_cd, room_nights, room_rev_usd FROM props",
)
def rev_prop_revenue(spark, sf):
    tables = views.stay_tables(spark, sf)
    stays = rev.stay_revenue(tables, START, END, "room")
    return rev.property_revenue(stays, rev.plan_rates(tables.fx_rates), ["v4"])


@query(
    "rev_period",
    """
    SELECT DISTINCT p AS period,
      strftime(d, '%Y-%m-%d') AS date_start_str, strftime(last_day(d), '%Y-%m-%d') AS date_end_str,
      strftime(d, '%Y%m%d') AS date_start_yyyymmdd, strftime(last_day(d), '%Y%m%d')
        AS date_end_yyyymmdd
    FROM (SELECT CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS p,
      CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders)""",
)
def rev_period(spark, sf):
    months = views.read(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyyMM").cast("int").alias("period")
    )
    columns = dates.period_columns(F.col("period"))
    texts = {k: v for k, v in columns.items() if k not in ("date_start", "date_end")}
    return months.distinct().withColumns(texts)


_POP_TEXT = """stay_id, prop_cd, CAST(extract_last_update_dtm AS VARCHAR)
  AS extract_last_update_dtm, currency_cd AS chckout_currency_cd,
  CAST(arrival_dt AS VARCHAR) AS arrival_dt, CAST(departure_dt AS VARCHAR) AS departure_dt"""


def as_text(df, *names):
    return df.withColumns({n: F.col(n).cast("string") for n in names})


@query("rev_population", f"WITH {POPULATION} SELECT {_POP_TEXT} FROM pop")
def rev_population(spark, sf):
    stays = rev.population(views.stay_tables(spark, sf), START, END)
    return as_text(stays, "extract_last_update_dtm", "arrival_dt", "departure_dt")


@query(
    "rev_days_excluded",
    f"""WITH {POPULATION} SELECT stay_id, CAST(days_before AS INTEGER)
      AS stay_period_days_exclude_before, CAST(days_after AS INTEGER)
      AS stay_period_days_exclude_after, CAST(days_before + days_after AS INTEGER)
      AS stay_period_days_exclude FROM pop""",
)
def rev_days_excluded(spark, sf):
    stays = rev.population(views.stay_tables(spark, sf), START, END)
    return rev.with_days_excluded(stays, START, END).select(
        "stay_id",
        "stay_period_days_exclude_before",
        "stay_period_days_exclude_after",
        "stay_period_days_exclude",
    )


@query(
    "rev_room_nights",
    """SELECT b.stay_id, CAST(room_cnt * date_diff('day', arrival_dt, departure_dt) AS INTEGER)
      AS room_nights
    FROM stay_curr_booking b JOIN stay s ON b.stay_id = s.stay_id AND b.stay_key = s.stay_key""",
)
def rev_room_nights(spark, sf):
    return rev.bookings(views.stay_tables(spark, sf))


_FACTOR_COLUMNS = """stay_id, prop_cd, CAST(room_nights AS INTEGER) AS room_nights,
  round(factor, 6) AS stay_period_inclusion_factor"""


def _rounded_factors(df):
    return df.select(
        "stay_id",
        "prop_cd",
        "room_nights",
        F.round("stay_period_inclusion_factor", 6).alias("stay_period_inclusion_factor"),
    )


@query("rev_inclusion_factor", f"WITH {FACTORS} SELECT {_FACTOR_COLUMNS} FROM factors")
def rev_inclusion_factor(spark, sf):
    return _rounded_factors(rev.stay_factors(views.stay_tables(spark, sf), START, END))


@query(
    "rev_date_logic",
    f"""WITH {POPULATION},
    booked AS (
      SELECT p.*, s.room_cnt * date_diff('day', s.arrival_dt, s.departure_dt) AS room_nights
      FROM pop p JOIN stay_curr_booking b ON p.stay_id = b.stay_id
        JOIN stay s ON b.stay_id = s.stay_id AND b.stay_key = s.stay_key
      WHERE p.arrival_dt >= {_S})
    SELECT stay_id, prop_cd, CAST(room_nights AS INTEGER) AS room_nights,
      CAST(1.0 AS DOUBLE) AS stay_period_inclusion_factor FROM booked""",
)
def rev_date_logic(spark, sf):
    tables = views.stay_tables(spark, sf)
    return _rounded_factors(rev.stay_factors(tables, START, END, date_logic="arrival"))


@query(
    "rev_primary_category",
    f"""WITH {CANDIDATES},{TXN} SELECT * FROM primary_cat""",
)
def rev_primary_category(spark, sf):
    tables = views.stay_tables(spark, sf)
    bounds = rev.extract_bounds(rev.candidate_stays(tables, START, END))
    return rev.primary_category(rev.within_bounds(tables.transactions, bounds))


def _register_version(version: str, category: str):
    @query(
        f"rev_logic_{version}",
        f"""WITH {stay_sql(category)},{prop_sql(version)}
        SELECT prop_cd, room_nights, room_rev_usd AS {category}_rev_usd FROM props""",
    )
    def run(spark, sf):
        tables = views.stay_tables(spark, sf)
        stays = rev.stay_revenue(tables, START, END, category)
        rates = rev.plan_rates(tables.fx_rates)
        return rev.property_revenue(stays, rates, [version], f"{category}_rev_usd")


for _version, _category in [("v1", "room"), ("v2", "food"), ("v3", "room"), ("v4", "tax")]:
    _register_version(_version, _category)


@query(
    "rev_stay_versions",
    f"""WITH {stay_sql('room')} SELECT prop_cd, stay_id, CAST(lc_v1 AS DOUBLE) AS room_rev_v1,
      CAST(lc_v2 AS DOUBLE) AS room_rev_v2, CAST(lc_v3 AS DOUBLE) AS room_rev_v3,
      CAST(lc_v4 AS DOUBLE) AS room_rev_v4 FROM stays""",
)
def rev_stay_versions(spark, sf):
    return _stay_versions(spark, sf, None)


def _stay_versions(spark, sf, chosen):
    stays = rev.stay_revenue(views.stay_tables(spark, sf), START, END, "room", chosen=chosen)
    return stays.select(
        "prop_cd",
        "stay_id",
        *[F.col(f"lc_{v}").cast("double").alias(f"room_rev_{v}") for v in rev.VERSIONS],
    )


# The deep dives: properties of one country, and stays of the customers of one segment.
def _chosen_sql(condition: str) -> str:
    columns = ", ".join(f"CAST(lc_{v} AS DOUBLE) AS room_rev_{v}" for v in rev.VERSIONS)
    return f"WITH {stay_sql('room')} SELECT prop_cd, stay_id, {columns} FROM stays WHERE {condition}"


@query(
    "rev_chosen_properties",
    _chosen_sql("prop_cd IN (SELECT 'P' || (c_custkey % 97) FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING')"),
)
def rev_chosen_properties(spark, sf):
    number = (F.col("c_custkey") % 97).cast("string")
    chosen = views.read(spark, sf, "customer").filter("c_nationkey = 7 AND c_mktsegment = 'BUILDING'")
    return _stay_versions(spark, sf, chosen.select(F.concat(F.lit("P"), number).alias("prop_cd")))


@query(
    "rev_chosen_stays",
    _chosen_sql(
        "stay_id IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey "
        "WHERE c_mktsegment = 'BUILDING')"
    ),
)
def rev_chosen_stays(spark, sf):
    customers = views.read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = views.read(spark, sf, "orders")
    chosen = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return _stay_versions(spark, sf, chosen.select(F.col("o_orderkey").alias("stay_id")))


_INCLUDE = "CASE WHEN {0} THEN 'include' ELSE 'exclude' END AS {1}"


@query(
    "rev_txn_flags",
    f"""WITH {stay_sql('room')} SELECT prop_cd, stay_id, folio_id, trans_id, entry_type,
      CAST(ledger_entry_amt AS DOUBLE) AS ledger_entry_amt, primary_charge_category,
      {_INCLUDE.format("true", "in_v1")}, {_INCLUDE.format("is2", "in_v2")},
      {_INCLUDE.format("is3", "in_v3")}, {_INCLUDE.format("f1 OR f2 OR f3", "in_v4")}
    FROM flags""",
)
def rev_txn_flags(spark, sf):
    flags = rev.transaction_flags(views.stay_tables(spark, sf), START, END, "room")
    return flags.select(
        "prop_cd",
        "stay_id",
        "folio_id",
        "trans_id",
        "entry_type",
        F.col("ledger_entry_amt").cast("double").alias("ledger_entry_amt"),
        "primary_charge_category",
        "in_v1",
        "in_v2",
        "in_v3",
        "in_v4",
    )
