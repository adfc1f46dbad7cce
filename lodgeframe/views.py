"""The domain's tables as views over a star schema of orders, and the same in SQL.

They give the revenue operators inputs that grow with the data at hand. Each
Spark view has a twin in ``SQL``, written for another engine, against which the
results are checked.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeframe.operators.revenue import StayTables

START, END = "1998-01-01", "1998-06-30"


@lru_cache(maxsize=256)
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; its schema is read from the files once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prop_cd(custkey: str) -> F.Column:
    return F.concat(F.lit("P"), (F.col(custkey) % 97).cast("string"))


def _with_dates(orders: DataFrame, extra_days=None) -> DataFrame:
    days = F.col("o_orderkey") % 29
    if extra_days is not None:
        days = days + extra_days
    return orders.withColumn("arrival_dt", F.to_date("o_orderdate")).withColumn(
        "departure_dt", F.date_add("arrival_dt", days.cast("int"))
    )


def checkout_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    orders = read(spark, sf_dir, "orders").withColumn("k", F.explode(version))
    custkey = F.col("o_custkey") % 4
    priority = F.col("o_orderpriority")
    return _with_dates(orders, F.col("k")).select(
        F.col("o_orderkey").alias("stay_id"),
        (F.col("o_orderkey") * 10 + F.col("k")).alias("checkout_detail_key"),
        prop_cd("o_custkey").alias("prop_cd"),
        "arrival_dt",
        "departure_dt",
        F.when(priority == "1-URGENT", "X").when(priority == "2-HIGH", "N").otherwise("C").alias(
            "prop_stay_status"
        ),
        F.when(custkey == 0, "USD").when(custkey == 1, "EUR").when(custkey == 2, "GBP")
        .otherwise("XXX").alias("currency_cd"),
        F.col("o_orderdate").alias("extract_last_update_dtm"),
    )


def checkout_curr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("stay_id"),
        (F.col("o_orderkey") * 10).alias("checkout_detail_key"),
    )


def stay_curr_booking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "orders")
        .filter(F.col("o_orderkey") % 50 != 7)
        .select(
            F.col("o_orderkey").alias("stay_id"), (F.col("o_orderkey") * 100).alias("stay_key")
        )
    )


def stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_dates(read(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("stay_id"),
        (F.col("o_orderkey") * 100).alias("stay_key"),
        (1 + F.col("o_custkey") % 3).cast("int").alias("room_cnt"),
        "arrival_dt",
        "departure_dt",
    )


def checkout_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    folio = (number % 3).cast("int")
    part = F.col("l_quantity").cast("int") % 5
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("stay_id"),
        F.col("o_orderdate").alias("extract_last_update_dtm"),
        folio.alias("folio_id"),
        F.when(F.col("l_suppkey") % 10 == 0, folio + 1).otherwise(folio).alias("trans_folio_id"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey")).alias("trans_id"),
        F.when(part == 0, "").when(part == 1, "food").when(part == 2, "tax").otherwise("room")
        .alias("charge_category"),
        F.when(number == 7, "PAYMT").when(flag == "A", "ADJUST").when(flag == "N", "CHARGE")
        .when(flag == "R", "ALLOWE").alias("entry_type"),
        F.when(F.col("l_linestatus") == "O", "P").otherwise("D").alias("posting_type"),
        F.when(F.col("l_suppkey") % 20 == 1, "RX").otherwise("RM").alias("acctg_category"),
        F.when(number != 5, number % 2 == 0).alias("charge_routed_ind"),
        F.when(F.col("l_discount") == 0, F.lit(0)).when(flag == "R", -price).otherwise(price)
        .cast("decimal(18,2)").alias("ledger_entry_amt"),
    )


def fx_rates(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT CAST(rate AS DOUBLE) AS exchange_rate, DATE '1998-01-01' AS rate_date,
          currency AS from_currency, 'USD' AS to_currency, kind AS conversion_type
        FROM VALUES ('USD', 1.0, 'Plan Exchange Rates'), ('EUR', 1.1, 'Plan Exchange Rates'),
          ('GBP', 1.25, 'Plan Exchange Rates'), ('EUR', 9.9, 'Daily Rates')
          AS rates(currency, rate, kind)"""
    )


def prop_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("c_custkey") % 97).cast("int").alias("number")
    numbers = read(spark, sf_dir, "customer").select(number).distinct().filter("number < 90")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return (
        numbers.join(nation, F.col("number") % 25 == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("P"), F.col("number").cast("string")).alias("prop_cd"),
            F.col("n_nationkey").alias("country_cd"),
            F.col("n_name").alias("country_desc"),
            F.col("r_name").alias("op_area_level2_desc"),
        )
    )


def stay_tables(spark: SparkSession, sf_dir: str) -> StayTables:
    return StayTables(
        checkout_curr=checkout_curr(spark, sf_dir),
        checkout_detail=checkout_detail(spark, sf_dir),
        booking_curr=stay_curr_booking(spark, sf_dir),
        booking=stay(spark, sf_dir),
        transactions=checkout_transaction(spark, sf_dir),
        fx_rates=fx_rates(spark),
    )


LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def lineitem_source(spark: SparkSession, sf_dir: str, placed_by: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Line items of the source side; keys are made unique by summing repeats.

    Rows are shuffled by ``placed_by``, some of the keys, and summed where they lie: next to none repeat, so
    sums before the shuffle would only sort them once more. By order, all that compares orders finds their few lines together.
    """
    lines = read(spark, sf_dir, "lineitem").repartition(*placed_by)
    return lines.groupBy(*LINE_KEYS).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("l_quantity"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias(
            "l_extendedprice"
        ),
        F.min("l_returnflag").alias("l_returnflag"),
        F.min("l_linestatus").alias("l_linestatus"),
    )


def lineitem_target(spark: SparkSession, sf_dir: str, placed_by: Sequence[str] = LINE_KEYS) -> DataFrame:
    """The same after a faulty load: rows lost, amounts and flags changed."""
    key = F.col("l_orderkey")
    flag = F.col("l_returnflag")
    return (
        lineitem_source(spark, sf_dir, placed_by)
        .filter(key % 250 != 1)
        .withColumns(
            {
                "l_quantity": F.when(key % 100 == 0, F.col("l_quantity") + 5).otherwise(
                    F.col("l_quantity")
                ),
                "l_returnflag": F.when(key % 300 == 0, F.lit("X"))
                .when(key % 700 == 0, F.lit(None).cast("string"))
                .otherwise(flag),
            }
        )
    )


# ---------------------------------------------------------------- SQL twins

_ARRIVAL = "CAST(o_orderdate AS DATE)"

SQL = {
    "checkout_detail": f"""
        SELECT o_orderkey AS stay_id, o_orderkey * 10 + k AS checkout_detail_key,
          'P' || (o_custkey % 97) AS prop_cd, {_ARRIVAL} AS arrival_dt,
          {_ARRIVAL} + CAST(o_orderkey % 29 + k AS INTEGER) AS departure_dt,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'X' WHEN '2-HIGH' THEN 'N' ELSE 'C' END
            AS prop_stay_status,
          CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'XXX' END
            AS currency_cd,
          o_orderdate AS extract_last_update_dtm
        FROM orders, (VALUES (0), (1)) AS versions(k)
        WHERE k = 0 OR o_orderkey % 2 = 0""",
    "checkout_curr": """
        SELECT o_orderkey AS stay_id, o_orderkey * 10 AS checkout_detail_key FROM orders""",
    "stay_curr_booking": """
        SELECT o_orderkey AS stay_id, o_orderkey * 100 AS stay_key
        FROM orders WHERE o_orderkey % 50 <> 7""",
    "stay": f"""
        SELECT o_orderkey AS stay_id, o_orderkey * 100 AS stay_key, 1 + o_custkey % 3 AS room_cnt,
          {_ARRIVAL} AS arrival_dt,
          {_ARRIVAL} + CAST(o_orderkey % 29 AS INTEGER) AS departure_dt
        FROM orders""",
    "checkout_transaction": """
        SELECT l_orderkey AS stay_id, o_orderdate AS extract_last_update_dtm,
          l_linenumber % 3 AS folio_id,
          CASE WHEN l_suppkey % 10 = 0 THEN l_linenumber % 3 + 1 ELSE l_linenumber % 3 END
            AS trans_folio_id,
          CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END AS trans_id,
          CASE CAST(l_quantity AS INTEGER) % 5
            WHEN 0 THEN '' WHEN 1 THEN 'food' WHEN 2 THEN 'tax' ELSE 'room' END AS charge_category,
          CASE WHEN l_linenumber = 7 THEN 'PAYMT' WHEN l_returnflag = 'A' THEN 'ADJUST'
            WHEN l_returnflag = 'N' THEN 'CHARGE' WHEN l_returnflag = 'R' THEN 'ALLOWE' END
            AS entry_type,
          CASE WHEN l_linestatus = 'O' THEN 'P' ELSE 'D' END AS posting_type,
          CASE WHEN l_suppkey % 20 = 1 THEN 'RX' ELSE 'RM' END AS acctg_category,
          CASE WHEN l_linenumber <> 5 THEN l_linenumber % 2 = 0 END AS charge_routed_ind,
          CASE WHEN l_discount = 0 THEN CAST(0 AS DECIMAL(18,2))
            WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2))
            ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS ledger_entry_amt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_rates": """
        SELECT * FROM (VALUES
          (CAST(1.0 AS DOUBLE), 'USD', 'USD', 'Plan Exchange Rates'),
          (CAST(1.1 AS DOUBLE), 'EUR', 'USD', 'Plan Exchange Rates'),
          (CAST(1.25 AS DOUBLE), 'GBP', 'USD', 'Plan Exchange Rates'),
          (CAST(9.9 AS DOUBLE), 'EUR', 'USD', 'Daily Rates'))
          AS f(exchange_rate, from_currency, to_currency, conversion_type)""",
    "prop_hierarchy": """
        SELECT 'P' || number AS prop_cd, n_nationkey AS country_cd, n_name AS country_desc,
          r_name AS op_area_level2_desc
        FROM (SELECT DISTINCT c_custkey % 97 AS number FROM customer) AS numbers
          JOIN nation ON number % 25 = n_nationkey
          JOIN region ON n_regionkey = r_regionkey
        WHERE number < 90""",
    "lineitem_source": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS l_quantity,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice,
          min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus
        FROM lineitem GROUP BY ALL""",
    "lineitem_target": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CASE WHEN l_orderkey % 100 = 0 THEN l_quantity + 5 ELSE l_quantity END AS l_quantity,
          l_extendedprice,
          CASE WHEN l_orderkey % 300 = 0 THEN 'X' WHEN l_orderkey % 700 = 0 THEN NULL
            ELSE l_returnflag END AS l_returnflag,
          l_linestatus
        FROM lineitem_source WHERE l_orderkey % 250 <> 1""",
}


def with_views(sql: str) -> str:
    """Prefix a statement with the views it names, and those that they name."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(body)
                if name not in needed:
                    needed.append(name)

    add(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS ({SQL[name]})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
