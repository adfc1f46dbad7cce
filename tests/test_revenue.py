import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodgeframe.operators import revenue as rev

START, END = "2025-06-08", "2025-06-14"
T0 = datetime(2025, 6, 1)


def d(day, month=6):
    return date(2025, month, day)


def tables(spark, details, bookings, txns, rates=(("USD", 1.0), ("EUR", 2.0))):
    """Inputs from short rows; every stay's current version has key 1."""
    detail = spark.createDataFrame(
        [(s, k, p, T0 + timedelta(hours=h), c, a, b, st) for s, k, p, h, c, a, b, st in details],
        "stay_id int, checkout_detail_key int, prop_cd string, extract_last_update_dtm timestamp, "
        "currency_cd string, arrival_dt date, departure_dt date, prop_stay_status string",
    )
    curr = spark.createDataFrame(
        [(s, 1) for s in {x[0] for x in details}], "stay_id int, checkout_detail_key int"
    )
    booking = spark.createDataFrame(
        bookings, "stay_id int, stay_key int, room_cnt int, arrival_dt date, departure_dt date"
    )
    booking_curr = spark.createDataFrame([(b[0], 7) for b in bookings], "stay_id int, stay_key int")
    transactions = spark.createDataFrame(
        [(t[0], T0 + timedelta(hours=t[1]), *t[2:]) for t in txns],
        "stay_id int, extract_last_update_dtm timestamp, folio_id int, trans_folio_id int, "
        "trans_id int, charge_category string, entry_type string, posting_type string, "
        "acctg_category string, charge_routed_ind boolean, amt double",
    ).withColumn("ledger_entry_amt", F.col("amt").cast("decimal(18,2)"))
    fx = spark.createDataFrame(
        [(r, c, "USD", rev.PLAN_RATES) for c, r in rates] + [(9.0, "EUR", "USD", "Daily")],
        "exchange_rate double, from_currency string, to_currency string, conversion_type string",
    )
    return rev.StayTables(curr, detail, booking_curr, booking, transactions, fx)


def room(stay, amount, hour=0, trans=1, folio=1, category="room", entry="CHARGE", posting="P",
         account="RM", routed=False, own=True):
    return (stay, hour, folio, folio if own else folio + 1, trans, category, entry, posting,
            account, routed, amount)


def test_population(spark):
    details = [
        (1, 1, "A", 0, "USD", d(8), d(8), "C"),  # same-day stay on the first day
        (2, 1, "A", 0, "USD", d(5), d(8), "C"),  # leaves on the first day
        (3, 1, "A", 0, "USD", d(1), d(30), "C"),  # longer than the window
        (4, 1, "A", 0, "USD", d(9), d(10), "X"),  # cancelled
        (5, 1, "A", 0, "USD", d(9), d(10), None),  # status unknown
        (6, 1, "A", 0, "USD", d(14), d(16), "C"),
        (7, 1, "A", 0, "USD", d(15), d(16), "C"),  # after the window
        (8, 2, "A", 0, "USD", d(9), d(10), "C"),  # not the current version
    ]
    bookings = [(i, 7, 1, d(9), d(10)) for i in range(1, 9)]
    t = tables(spark, details, bookings, [room(1, 1.0)])
    stays = rev.with_days_excluded(rev.population(t, START, END), START, END)
    got = rows(stays.select("stay_id", "stay_period_days_exclude_before",
                            "stay_period_days_exclude_after"))
    assert got == [(1, 0, 0), (3, 7, 15), (6, 0, 1)]
    arrivals = rev.population(t, START, END, "arrival")
    assert rows(arrivals.select("stay_id")) == [(1,), (6,)]
    with pytest.raises(ValueError):
        rev.population(t, START, END, "departure")


def test_inclusion_factor(spark):
    df = spark.createDataFrame([(0, 3), (10, 0), (10, 4), (30, 4), (None, 1)], "n int, x int")
    got = df.select(rev.inclusion_factor(F.col("n"), F.col("x")))
    assert [r[0] for r in got.collect()] == [1.0, 1.0, 0.6, 1 - 4 / 30, 1.0]


def test_factor_in_unit_interval_for_one_room(spark):
    days = [(a, b) for a in range(1, 29) for b in range(a, 30)]
    details = [(i, 1, "A", 0, "USD", d(a), d(b), "C") for i, (a, b) in enumerate(days)]
    bookings = [(i, 7, 1, d(a), d(b)) for i, (a, b) in enumerate(days)]
    t = tables(spark, details, bookings, [room(0, 1.0)])
    bad = rev.stay_factors(t, START, END).filter(
        (F.col("stay_period_inclusion_factor") < 0) | (F.col("stay_period_inclusion_factor") > 1)
    )
    assert bad.count() == 0


def one_stay(spark, txns, category="room"):
    t = tables(
        spark, [(1, 1, "A", 0, "USD", d(9), d(11), "C")], [(1, 7, 1, d(9), d(11))], txns
    )
    found = rev.stay_revenue(t, START, END, category).collect()
    if not found:
        return None
    r = found[0]
    return [float(r[c] or 0) for c in ("lc_v1", "lc_v2", "lc_v3", "rev_filter_1", "rev_filter_2",
                                       "rev_filter_3", "lc_v4")]


def test_versions(spark):
    got = one_stay(
        spark,
        [
            room(1, 100.0),
            room(1, 10.0, trans=2, routed=True),
            room(1, 1.0, trans=3, routed=None),
            room(1, 1000.0, trans=4, entry="PAYMT"),
            room(1, 5000.0, trans=5, posting="D"),
            room(1, 7.0, trans=6, own=False),
        ],
    )
    assert got == [6118.0, 107.0, 118.0, 111.0, 0.0, 0.0, 111.0]


def test_higher_category_takes_the_transaction(spark):
    rows_ = [room(1, 100.0), room(1, 5.0, category="tax"), room(1, 20.0, trans=2)]
    assert one_stay(spark, rows_)[3:] == [20.0, 0.0, 0.0, 20.0]
    # a row that cannot set the primary category does not
    rows_[1] = room(1, 5.0, category="tax", posting="D")
    assert one_stay(spark, rows_)[3:] == [120.0, 0.0, 0.0, 120.0]
    # nor does a lower one
    rows_[1] = room(1, 5.0, category="food")
    assert one_stay(spark, rows_)[3:] == [120.0, 0.0, 0.0, 120.0]


def test_account_rx_counts_twice_and_without_transaction_id(spark):
    got = one_stay(spark, [room(1, 50.0, account="RX"), room(1, 8.0, trans=None, account="RX")])
    assert got[3:] == [50.0, 0.0, 58.0, 108.0]


def test_tax_allowances(spark):
    got = one_stay(
        spark,
        [room(1, -9.0, category="tax", entry="ALLOWE"), room(1, 30.0, category="tax", trans=2)],
        "tax",
    )
    assert got[3:] == [21.0, -9.0, 0.0, 12.0]


def test_only_rows_of_the_stays_version_count(spark):
    # the other stay widens the bounds, so hour 1 is read but is not this stay's version
    t = tables(
        spark,
        [(1, 1, "A", 0, "USD", d(9), d(11), "C"), (2, 1, "A", 2, "USD", d(9), d(11), "C")],
        [(1, 7, 1, d(9), d(11)), (2, 7, 1, d(9), d(11))],
        [room(1, 100.0), room(1, 30.0, hour=1), room(1, 4.0, hour=1, category="tax"),
         room(2, 1.0, hour=2)],
    )
    got = {r["stay_id"]: float(r["lc_v1"]) for r in rev.stay_revenue(t, START, END).collect()}
    assert got == {1: 100.0, 2: 1.0}
    # the tax row of another version still makes the transaction a tax transaction
    v4 = {r["stay_id"]: float(r["lc_v4"]) for r in rev.stay_revenue(t, START, END).collect()}
    assert v4 == {1: 0.0, 2: 1.0}


def test_stay_without_rows_of_the_category(spark):
    assert one_stay(spark, [room(1, 5.0, category="tax")]) is None


def test_unknown_category():
    with pytest.raises(ValueError):
        rev.check_category("spa")


def property_rows(spark, currency, rates):
    t = tables(
        spark,
        [(1, 1, "A", 0, currency, d(9), d(11), "C"), (2, 1, "A", 0, "USD", d(7), d(11), "C")],
        [(1, 7, 1, d(9), d(11)), (2, 7, 1, d(7), d(11))],
        [room(1, 100.0), room(2, 40.0)],
        rates,
    )
    stays = rev.stay_revenue(t, START, END)
    return rev.property_revenue(stays, rev.plan_rates(t.fx_rates), ["v4"]).collect(), t


def test_property_revenue(spark):
    got, _ = property_rows(spark, "EUR", [("USD", 1.0), ("EUR", 2.0)])
    assert [tuple(r) for r in got] == [("A", 5.0, 230.0)]


def test_missing_rate_adds_nothing(spark):
    got, _ = property_rows(spark, "XXX", [("USD", 1.0)])
    assert [tuple(r) for r in got] == [("A", 5.0, 30.0)]


def test_two_rates_fan_out_and_can_be_refused(spark):
    got, t = property_rows(spark, "EUR", [("USD", 1.0), ("EUR", 2.0), ("EUR", 3.0)])
    assert [tuple(r) for r in got] == [("A", 7.0, 530.0)]
    with pytest.raises(ValueError):
        rev.check_unique_rates(rev.plan_rates(t.fx_rates))


def test_hot_stay_is_whole(spark):
    """A stay with most of all rows is summed like any other."""
    txns = [room(1, 1.0, trans=i % 50, folio=i % 3) for i in range(3000)]
    t = tables(
        spark,
        [(i, 1, "A", 0, "USD", d(9), d(11), "C") for i in range(1, 5)],
        [(i, 7, 1, d(9), d(11)) for i in range(1, 5)],
        txns + [room(i, 5.0) for i in range(2, 5)],
    )
    got = {r["stay_id"]: float(r["lc_v4"]) for r in rev.stay_revenue(t, START, END).collect()}
    assert got == {1: 3000.0, 2: 5.0, 3: 5.0, 4: 5.0}


def test_version_table(spark):
    got = rev.version_table(spark, "food").collect()
    assert [r["version"] for r in got] == ["v1", "v2", "v3", "v4"]
    assert got[0]["filter logic"] == "(current): charge_category = food"


def test_transaction_report_shows_the_true_primary_category(spark):
    t = tables(
        spark,
        [(1, 1, "A", 0, "USD", d(9), d(11), "C")],
        [(1, 7, 1, d(9), d(11))],
        [
            room(1, 100.0, posting="D"),
            room(1, 5.0, category="food"),
            room(1, 9.0, trans=2),
            room(1, 3.0, trans=3, routed=None, own=False),
            room(1, 2.0, trans=None, account="RX"),
        ],
    )
    got = rev.transaction_flags(t, START, END).select(
        "ledger_entry_amt", "primary_charge_category", "in_v1", "in_v2", "in_v3", "in_v4"
    )
    yes, no = "include", "exclude"
    assert sorted((float(r[0]), *r[1:]) for r in got.collect()) == [
        (2.0, None, yes, yes, yes, yes),
        (3.0, "room", yes, no, yes, no),
        (9.0, "room", yes, yes, yes, yes),
        (100.0, "food", yes, no, no, no),
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_revenue_against_brute_force(spark, seed):
    """Random transactions, summed row by row in Python."""
    rnd = random.Random(seed)
    stays = range(1, 9)
    details = [(s, 1, "A", s % 3, "USD", d(9), d(11), "C") for s in stays]
    bookings = [(s, 7, 1, d(9), d(11)) for s in stays]
    txns = [
        room(
            rnd.choice([1, *stays]),
            float(rnd.randint(-3, 9)),
            hour=rnd.randint(0, 3),
            trans=rnd.choice([None, 1, 2, 3]),
            folio=rnd.choice([1, 2]),
            category=rnd.choice(["room", "room", "tax", "food", "", "shop"]),
            entry=rnd.choice(["CHARGE", "ADJUST", "ALLOWE", "PAYMT"]),
            posting=rnd.choice(["P", "P", "D"]),
            account=rnd.choice(["RM", "RX"]),
            routed=rnd.choice([True, False, None]),
            own=rnd.random() < 0.8,
        )
        for _ in range(400)
    ]
    t = tables(spark, details, bookings, txns)
    for category in ("room", "tax"):
        primary = {}
        for s, h, f, tf, tr, cat, e, p, acc, routed, amt in txns:
            if h <= 2 and cat and p == "P" and tr is not None and amt:
                primary[s, f, tr] = max(primary.get((s, f, tr), ""), cat)
        expected = {}
        for s, h, f, tf, tr, cat, e, p, acc, routed, amt in txns:
            if h != s % 3 or cat != category:
                continue
            sums = expected.setdefault(s, [0.0] * 4)
            posted = e in ("CHARGE", "ADJUST", "ALLOWE") and p == "P"
            sums[0] += amt
            sums[1] += amt * (posted and routed is False)
            sums[2] += amt * posted
            if f == tf:
                first = primary.get((s, f, tr))
                sums[3] += amt * (first == cat and e in ("CHARGE", "ADJUST", "ALLOWE"))
                sums[3] += amt * (first == cat == "tax" and e == "ALLOWE")
                sums[3] += amt * (cat == "room" and acc == "RX")
        got = {
            r["stay_id"]: [float(r[f"lc_{v}"]) for v in rev.VERSIONS]
            for r in rev.stay_revenue(t, START, END, category).collect()
        }
        assert got == expected
