"""Revenue recognition: which stays count, for how much of their time, and for which amounts.

The transaction table is by far the largest input. It is read once, bounded by
the extract times of the stays in question, narrowed to the rows that can
matter for the category, and reduced to one row per stay before anything else
is joined to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.functions import dates
from lodgeframe.sources.scratch import written

# Status codes of cancelled and no-show stays.
EXCLUDED_STATUS = ["N", "X"]

# Entry types that are revenue.
REVENUE_ENTRY_TYPES = ["CHARGE", "ADJUST", "ALLOWE"]

# Charge categories that have a revenue.
CATEGORIES = ["room", "food", "beverage", "misc", "package", "phone", "shop", "tax"]

# What each version of the revenue logic counts.
VERSION_RULES = {
    "v1": "(current): charge_category = {category}",
    "v2": "(new): charge_category = {category}, entry_type = (CHARGE, ADJUST, ALLOWE), "
    "posting_type = P, charge_routed_ind <> true",
    "v3": "(new): charge_category = {category}, entry_type = (CHARGE, ADJUST, ALLOWE), "
    "posting_type = P",
    "v4": "(new): primary category of the own folio, plus room entries in account RX",
}
VERSIONS = list(VERSION_RULES)

PLAN_RATES = "Plan Exchange Rates"

AMOUNT = "decimal(28,6)"

# Tasks that the transactions of one stay are dealt to.
SALTS = 8


@dataclass(frozen=True)
class StayTables:
    """The six inputs of revenue recognition."""

    checkout_curr: DataFrame
    checkout_detail: DataFrame
    booking_curr: DataFrame
    booking: DataFrame
    transactions: DataFrame
    fx_rates: DataFrame


def check_category(category: str) -> str:
    if category not in CATEGORIES:
        raise ValueError(f"unknown charge category {category!r}, expected one of {CATEGORIES}")
    return category


def version_table(spark: SparkSession, category: str) -> DataFrame:
    rows = [(v, rule.format(category=check_category(category))) for v, rule in VERSION_RULES.items()]
    return spark.createDataFrame(rows, "version string, `filter logic` string")


# ---------------------------------------------------------------- stays


def current_details(curr: DataFrame, detail: DataFrame) -> DataFrame:
    """Detail rows of the current version of each reservation."""
    keys = ["stay_id", "checkout_detail_key"]
    return detail.join(curr.select(*keys), keys, "inner")


def filter_overlap(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(
        dates.overlaps(
            F.col("arrival_dt"), F.col("departure_dt"), F.lit(start).cast("date"), F.lit(end).cast("date")
        )
    )


def filter_status(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("prop_stay_status").isin(EXCLUDED_STATUS))


def filter_same_day(df: DataFrame, start: str) -> DataFrame:
    return df.filter(
        dates.not_ending_on_start(
            F.col("arrival_dt"), F.col("departure_dt"), F.lit(start).cast("date")
        )
    )


def candidate_stays(tables: StayTables, start: str, end: str) -> DataFrame:
    """Current, non-cancelled stays that touch the window."""
    detail = filter_status(filter_overlap(tables.checkout_detail, start, end))
    return current_details(tables.checkout_curr, detail)


def extract_bounds(candidates: DataFrame) -> DataFrame:
    """First and last extract time of a set of stays.

    The two are kinds of aggregates that Spark does not merge into one
    subquery: only a subquery with a single plain value reaches the row-group
    statistics of the scan it bounds.
    """
    ts = F.col("extract_last_update_dtm")
    return candidates.agg(
        F.min(ts).alias("extract_last_update_dtm_min"),
        F.max_by(ts, F.struct(ts)).alias("extract_last_update_dtm_max"),
    )


def within_bounds(transactions: DataFrame, bounds: DataFrame) -> DataFrame:
    """Transactions extracted between two times known only at run time.

    The bounds are scalar subqueries: Spark runs them first and hands their
    values to the scan, where they skip row groups.
    """
    ts = F.col("extract_last_update_dtm")
    low = bounds.select("extract_last_update_dtm_min").scalar()
    high = bounds.select("extract_last_update_dtm_max").scalar()
    return transactions.filter((ts >= low) & (ts <= high))


def population(
    tables: StayTables,
    start: str,
    end: str,
    date_logic: str = "stay",
    chosen: DataFrame | None = None,
) -> DataFrame:
    """Stays to recognise revenue for.

    ``date_logic="stay"`` takes every stay with a date in the window;
    ``"arrival"`` only stays that arrive in it. ``chosen`` keeps only the stays or properties
    it lists, by its columns ``stay_id`` and ``prop_cd`` (either or both).
    """
    stays = filter_same_day(candidate_stays(tables, start, end), start)
    if chosen is not None:
        keys = [c for c in ("prop_cd", "stay_id") if c in chosen.columns]
        if not keys:
            raise ValueError("the chosen stays need a column stay_id or prop_cd")
        stays = stays.join(chosen.select(*keys), keys, "left_semi")
    if date_logic == "arrival":
        stays = stays.filter(F.col("arrival_dt") >= F.lit(start).cast("date"))
    elif date_logic != "stay":
        raise ValueError(f"date_logic must be 'stay' or 'arrival', not {date_logic!r}")
    return stays.select(
        "stay_id",
        "prop_cd",
        "extract_last_update_dtm",
        F.col("currency_cd").alias("chckout_currency_cd"),
        "arrival_dt",
        "departure_dt",
    )


def with_days_excluded(stays: DataFrame, start: str, end: str) -> DataFrame:
    start_dt, end_dt = F.lit(start).cast("date"), F.lit(end).cast("date")
    before = dates.days_before(F.col("arrival_dt"), start_dt)
    after = dates.days_after(F.col("departure_dt"), end_dt)
    return stays.withColumns(
        {
            "stay_period_days_exclude_before": before,
            "stay_period_days_exclude_after": after,
            "stay_period_days_exclude": before + after,
        }
    )


def room_nights() -> Column:
    return F.col("room_cnt") * F.datediff("departure_dt", "arrival_dt")


def bookings(tables: StayTables) -> DataFrame:
    """Room nights of the current booking of each stay."""
    return tables.booking.join(
        tables.booking_curr.select("stay_id", "stay_key"), ["stay_id", "stay_key"]
    ).select("stay_id", room_nights().alias("room_nights"))


def inclusion_factor(nights: Column, days_excluded: Column) -> Column:
    """Share of a stay inside the window.

    Days are divided by room nights, so the share is not exact for stays with
    several rooms.
    """
    share = 1 - F.try_divide(days_excluded.cast("double"), nights.cast("double"))
    return F.when(nights >= 1, share).otherwise(F.lit(1.0))


def stay_factors(
    tables: StayTables,
    start: str,
    end: str,
    date_logic: str = "stay",
    chosen: DataFrame | None = None,
) -> DataFrame:
    """The population with room nights and the share of the stay to recognise."""
    stays = with_days_excluded(population(tables, start, end, date_logic, chosen), start, end)
    booked = stays.join(tables.booking_curr.select("stay_id", "stay_key"), "stay_id").join(
        tables.booking.select("stay_id", "stay_key", room_nights().alias("room_nights")),
        ["stay_id", "stay_key"],
    )
    if date_logic == "arrival":
        factor = F.lit(1.0)
    else:
        factor = inclusion_factor(F.col("room_nights"), F.col("stay_period_days_exclude"))
    return booked.select(
        "stay_id",
        "prop_cd",
        "extract_last_update_dtm",
        "chckout_currency_cd",
        "room_nights",
        factor.alias("stay_period_inclusion_factor"),
    )


# ---------------------------------------------------------------- transactions


def is_own_folio() -> Column:
    return F.col("folio_id") == F.col("trans_folio_id")


def can_set_primary_category() -> Column:
    return (
        (F.col("charge_category") != "")
        & (F.col("posting_type") == "P")
        & F.col("trans_id").isNotNull()
        & (F.col("ledger_entry_amt") != 0)
    )


def primary_category(transactions: DataFrame) -> DataFrame:
    """Highest category name of each transaction of a folio.

    Repeats of a category are dropped by hash, before and after the shuffle; only the few categories of a
    transaction are then compared, so no texts are sorted.
    """
    keys = ["stay_id", "folio_id", "trans_id"]
    each = transactions.filter(can_set_primary_category()).select(*keys, "charge_category").distinct()
    return each.groupBy(*keys).agg(
        F.array_max(F.collect_set("charge_category")).alias("primary_charge_category")
    )


def is_v1(category: str) -> Column:
    return F.col("charge_category") == category


def is_v3(category: str) -> Column:
    return (
        is_v1(category)
        & F.col("entry_type").isin(REVENUE_ENTRY_TYPES)
        & (F.col("posting_type") == "P")
    )


def is_v2(category: str) -> Column:
    # a charge not known to be routed or not is left out, as SQL's <> does
    return is_v3(category) & (F.col("charge_routed_ind") != F.lit(True))


def v4_filters(category: str, primary: Column) -> dict[str, Column]:
    """The three tests of v4, on rows of the category. A row may pass more than one."""
    own = is_v1(category) & is_own_folio() & (F.col("ledger_entry_amt") != 0)
    return {
        "rev_filter_1": own
        & (primary == category)
        & F.col("entry_type").isin(REVENUE_ENTRY_TYPES),
        "rev_filter_2": own
        & F.lit(category == "tax")
        & (primary == "tax")
        & (F.col("entry_type") == "ALLOWE"),
        "rev_filter_3": own & F.lit(category == "room") & (F.col("acctg_category") == "RX"),
    }


def category_transactions(transactions: DataFrame, category: str) -> DataFrame:
    """The narrow rows that can matter for one category.

    A transaction's primary category is the category itself exactly when a
    qualifying row has it and no qualifying row has a higher one. So rows of
    lower categories are dropped at the scan, and two flags replace the text.
    """
    cat, amount = F.col("charge_category"), F.col("ledger_entry_amt")
    sets_primary = can_set_primary_category()
    tests = v4_filters(category, F.lit(category))
    return transactions.filter(cat >= category).select(
        "stay_id",
        "folio_id",
        "trans_id",
        F.col("extract_last_update_dtm").alias("txn_dtm"),
        F.when(sets_primary & (cat == category), 1).alias("has_category"),
        F.when(sets_primary & (cat > category), 1).alias("has_higher"),
        F.when(is_v1(category), 1).alias("in_category"),
        F.when(is_v1(category), amount).alias("v1_amt"),
        F.when(is_v2(category), amount).alias("v2_amt"),
        F.when(is_v3(category), amount).alias("v3_amt"),
        # the first two tests also need the primary category, known per transaction
        F.when(tests["rev_filter_1"], amount).alias("f1_amt"),
        F.when(tests["rev_filter_2"], amount).alias("f2_amt"),
        F.when(tests["rev_filter_3"], amount).alias("f3_amt"),
    )


def dealt(rows: DataFrame, stays: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Both with a column ``salt``, to be joined by ``stay_id`` and it: a stay with very many rows is dealt to
    several tasks by a hash of the row, and the much smaller stays are repeated for each."""
    of_row = F.xxhash64(*[c for c in rows.columns if c != "stay_id"])
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    return rows.withColumn("salt", F.pmod(of_row, F.lit(salts))), stays.withColumn("salt", F.explode(every))


def stay_revenue(
    tables: StayTables,
    start: str,
    end: str,
    category: str = "room",
    date_logic: str = "stay",
    chosen: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Revenue of each stay in local currency, under all versions side by side.

    ``chosen`` limits the run to some stays or properties, which get the same revenue as in a run
    over all. One read of the transactions serves every version. Both groupings combine
    before they shuffle, so a stay or transaction with very many rows is
    summed where it is read. ``salts`` is the number of tasks that the transactions of a stay are dealt to.
    """
    check_category(category)
    stays = stay_factors(tables, start, end, date_logic, chosen)
    bounds = extract_bounds(candidate_stays(tables, start, end))
    rows = category_transactions(within_bounds(tables.transactions, bounds), category)

    stay_keys = [
        "prop_cd",
        "stay_id",
        "chckout_currency_cd",
        "room_nights",
        "stay_period_inclusion_factor",
    ]
    of_version = F.col("txn_dtm") == F.col("extract_last_update_dtm")

    def version_sum(name: str) -> Column:
        return F.sum(F.when(of_version, F.col(name))).alias(name)

    # As the salt is no grouping key, the sums below need a shuffle of their own, after combining; that also
    # lets adaptive execution split what is still too large.
    salted_rows, salted_stays = dealt(rows, stays, salts)

    amounts = ["in_category", "v1_amt", "v2_amt", "v3_amt", "f1_amt", "f2_amt", "f3_amt"]
    per_transaction = (
        salted_rows.join(salted_stays, ["stay_id", "salt"])
        .groupBy(*stay_keys, "extract_last_update_dtm", "folio_id", "trans_id")
        .agg(
            F.max("has_category").alias("has_category"),
            F.max("has_higher").alias("has_higher"),
            *[version_sum(a) for a in amounts],
        )
    )
    # a missing folio or transaction id matches nothing, so it has no primary category
    is_primary = (
        F.col("has_category").isNotNull()
        & F.col("has_higher").isNull()
        & F.col("folio_id").isNotNull()
        & F.col("trans_id").isNotNull()
    )
    zero = F.lit(0)
    per_stay = per_transaction.groupBy(*stay_keys).agg(
        F.sum("in_category").alias("in_category"),
        *[F.coalesce(F.sum(f"{v}_amt"), zero).alias(f"lc_{v}") for v in ("v1", "v2", "v3")],
        F.coalesce(F.sum(F.when(is_primary, F.col("f1_amt"))), zero).alias("rev_filter_1"),
        F.coalesce(F.sum(F.when(is_primary, F.col("f2_amt"))), zero).alias("rev_filter_2"),
        F.coalesce(F.sum("f3_amt"), zero).alias("rev_filter_3"),
    )
    return (
        per_stay.filter(F.col("in_category").isNotNull())
        .drop("in_category")
        .withColumn("lc_v4", F.col("rev_filter_1") + F.col("rev_filter_2") + F.col("rev_filter_3"))
    )


def transaction_flags(
    tables: StayTables,
    start: str,
    end: str,
    category: str = "room",
    date_logic: str = "stay",
    chosen: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """The category's transactions of the population, with a flag per version; ``chosen`` as in
    population().

    The transactions are read once: those of the population that are of the category or can set a primary category are written
    first, and both uses read them there. The rows of a stay are dealt to ``salts`` tasks.
    """
    check_category(category)
    stays = stay_factors(tables, start, end, date_logic, chosen)
    bounds = extract_bounds(candidate_stays(tables, start, end))
    wanted = within_bounds(tables.transactions, bounds).filter(is_v1(category) | can_set_primary_category())
    salted, of_stays = dealt(wanted, stays.select("stay_id"), salts)
    inside = written(salted.join(of_stays, ["stay_id", "salt"], "left_semi").drop("salt"), "transactions")
    rows, of_stays = dealt(inside.filter(is_v1(category)), stays, salts)
    keys = ["stay_id", "folio_id", "trans_id"]
    rows = (
        rows.join(of_stays, ["stay_id", "extract_last_update_dtm", "salt"])
        .drop("salt")
        .join(primary_category(inside), keys, "left")
    )
    tests = v4_filters(category, F.col("primary_charge_category"))
    flags = {
        "in_v1": is_v1(category),
        "in_v2": is_v2(category),
        "in_v3": is_v3(category),
        "in_v4": tests["rev_filter_1"] | tests["rev_filter_2"] | tests["rev_filter_3"],
    }
    return rows.withColumns(
        {
            name: F.when(test, F.lit("include")).otherwise(F.lit("exclude"))
            for name, test in flags.items()
        }
    )


# ---------------------------------------------------------------- properties


def plan_rates(fx_rates: DataFrame, to_currency: str = "USD") -> DataFrame:
    return fx_rates.filter(
        (F.col("conversion_type") == PLAN_RATES) & (F.col("to_currency") == to_currency)
    ).select("from_currency", F.col("exchange_rate").alias("plan_exchange_rate"))


def check_unique_rates(rates: DataFrame) -> None:
    """Raise if a currency has several rates, each of which would count its revenue again."""
    repeated = rates.groupBy("from_currency").count().filter("count > 1").limit(20).collect()
    if repeated:
        raise ValueError(f"several rates for {sorted(str(r[0]) for r in repeated)}")


def property_revenue(
    stays: DataFrame, rates: DataFrame, versions: list[str], name: str = "room_rev_usd"
) -> DataFrame:
    """Prorated revenue per property in one currency, of one or several versions.

    Stays without revenue under a version do not count for it. Several rates
    for one currency each count, as a join does. Stays are summed per property
    and currency first: the join to the rates then sees a few rows per
    property, however common a currency is.
    """
    factor = F.col("stay_period_inclusion_factor")
    nights = (F.col("room_nights") * factor).cast(AMOUNT)
    sums = []
    for v in versions:
        counts = F.col(f"lc_{v}") != 0
        prorated = (F.col(f"lc_{v}").cast("double") * factor).cast(AMOUNT)
        sums.append(F.sum(F.when(counts, nights)).alias(f"nights_{v}"))
        sums.append(F.sum(F.when(counts, prorated)).alias(f"lc_{v}"))
    any_revenue = F.lit(False)
    for v in versions:
        any_revenue = any_revenue | (F.col(f"lc_{v}") != 0)
    local = stays.filter(any_revenue).groupBy("prop_cd", "chckout_currency_cd").agg(*sums)
    converted = local.join(rates, local.chckout_currency_cd == rates.from_currency, "left")

    def suffix(v: str) -> str:
        return "" if len(versions) == 1 else f"_{v}"

    out = []
    for v in versions:
        usd = (F.col(f"lc_{v}").cast("double") * F.col("plan_exchange_rate")).cast(AMOUNT)
        out.append(
            F.round(F.sum(f"nights_{v}"), 0).cast("double").alias(f"room_nights{suffix(v)}")
        )
        out.append(F.round(F.sum(usd), 2).cast("double").alias(f"{name}{suffix(v)}"))
    return converted.groupBy("prop_cd").agg(*out)
