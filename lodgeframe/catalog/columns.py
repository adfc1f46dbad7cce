"""Queries of projections, renames, predicates and conditionals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgeframe import views
from lodgeframe.catalog.registry import query
from lodgeframe.catalog.revenue import as_text, stay_sql
from lodgeframe.catalog.variance import AMOUNTS, amounts
from lodgeframe.functions.types import compare_type
from lodgeframe.operators import revenue as rev
from lodgeframe.operators import shape
from lodgeframe.views import END, START

_S, _E = f"DATE '{START}'", f"DATE '{END}'"


@query(
    "proj_existing_cols",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
)
def proj_existing_cols(spark, sf):
    order = ["no_such_column", "o_orderpriority", "o_orderkey", "o_orderstatus", "other"]
    return shape.select_existing(views.read(spark, sf, "orders"), order)


@query(
    "proj_rename_versions",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      s.l_quantity AS "room nights v2", t.l_quantity AS "room nights v1",
      s.l_extendedprice AS "room rev v2", t.l_extendedprice AS "room rev v1"
    FROM lineitem_source s JOIN lineitem_target t
      USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""",
)
def proj_rename_versions(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

    def extract(df, version):
        return df.select(
            *keys,
            F.col("l_quantity").alias(f"room_nights {version}"),
            F.col("l_extendedprice").alias(f"chkout_room_usd_amt {version}"),
        )

    both = extract(views.lineitem_source(spark, sf), "v2").join(
        extract(views.lineitem_target(spark, sf), "v1"), keys
    )
    return shape.rename_versions(both, "room", ["v2", "v1"])


@query(
    "proj_suffix_except_key",
    """SELECT c_custkey, c_name AS c_name_src, c_nationkey AS c_nationkey_src,
      c_acctbal AS c_acctbal_src, c_mktsegment AS c_mktsegment_src FROM customer""",
)
def proj_suffix_except_key(spark, sf):
    return shape.suffix_all_but(views.read(spark, sf, "customer"), ["c_custkey"], "_src")


@query(
    "proj_rename_upper_source",
    """SELECT o_orderkey AS stay_id, o_totalprice AS "room rev ABC v1",
      o_totalprice AS "room rev ABC v2", o_custkey AS "booking count"
    FROM orders""",
)
def proj_rename_upper_source(spark, sf):
    df = views.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("stay_id"),
        F.col("o_totalprice").alias("room_rev_abc_v1"),
        F.col("o_totalprice").alias("room_rev_abc_v2"),
        F.col("o_custkey").alias("booking_count"),
    )
    return shape.rename_upper_source(df, "room", keep=["stay_id"])


@query(
    "proj_positional_rename",
    """SELECT s_suppkey AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey,
      s_acctbal AS c_acctbal FROM supplier""",
)
def proj_positional_rename(spark, sf):
    like = views.read(spark, sf, "customer").drop("c_mktsegment")
    return shape.rename_positional(views.read(spark, sf, "supplier"), like)


@query(
    "proj_lower_names",
    """SELECT p_partkey AS part, p_name AS name, p_size AS size FROM part""",
)
def proj_lower_names(spark, sf):
    df = views.read(spark, sf, "part").select(
        F.col("p_partkey").alias("Part"),
        F.col("p_name").alias("Name.1"),
        F.col("p_size").alias("SIZE"),
    )
    return shape.lower_names(df)


@query(
    "proj_to_numeric",
    """SELECT p_partkey, round(TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN p_type
        ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE), 1) AS price,
      TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand, TRY_CAST(p_name AS DOUBLE) AS name
    FROM part""",
)
def proj_to_numeric(spark, sf):
    df = views.read(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_type"))
        .otherwise(F.col("p_retailprice").cast("string"))
        .alias("price"),
        F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand"),
        F.col("p_name").alias("name"),
    )
    return shape.to_numeric(df, {"price": 1, "brand": 0, "name": 2})


@query(
    "proj_all_string",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
      o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
      CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority
    FROM orders""",
)
def proj_all_string(spark, sf):
    df = views.read(spark, sf, "orders")
    return shape.all_string(df.withColumn("o_orderdate", F.to_date("o_orderdate")))


@query(
    "proj_cast_by_map",
    """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT)
      AS l_linenumber, CAST(l_returnflag AS VARCHAR) AS l_returnflag,
      CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate, l_tax
    FROM lineitem""",
)
def proj_cast_by_map(spark, sf):
    warehouse = {
        "l_orderkey": "bigint",
        "l_linenumber": "integer",
        "l_returnflag": "character varying",
        "l_shipdate": "date",
        "l_tax": "double precision",
    }
    df = views.read(spark, sf, "lineitem").select(*warehouse)
    df = df.withColumn("l_shipdate", F.to_date("l_shipdate"))
    return shape.cast_columns(df, {c: compare_type(t) for c, t in warehouse.items()})


@query(
    "proj_fill",
    f"""WITH {AMOUNTS} SELECT id, coalesce(a, 0) AS a, coalesce(b, 999) AS b,
      coalesce(CASE WHEN id % 3 <> 0 THEN 'known' END, 'Unknown') AS country FROM amounts""",
)
def proj_fill(spark, sf):
    df = amounts(spark, sf).withColumn("country", F.when(F.col("id") % 3 != 0, F.lit("known")))
    return shape.fill(df, {"a": 0.0, "b": 999.0, "country": "Unknown"})


@query("proj_coalesce", f"WITH {AMOUNTS} SELECT id, coalesce(a, b) AS value FROM amounts")
def proj_coalesce(spark, sf):
    return amounts(spark, sf).select("id", F.coalesce("a", "b").alias("value"))


_DETAIL = """stay_id, checkout_detail_key, prop_cd, CAST(arrival_dt AS VARCHAR) AS arrival_dt,
  CAST(departure_dt AS VARCHAR) AS departure_dt, prop_stay_status"""


def _detail(df):
    columns = "stay_id checkout_detail_key prop_cd arrival_dt departure_dt prop_stay_status"
    return as_text(df.select(*columns.split()), "arrival_dt", "departure_dt")


@query(
    "flt_overlap",
    f"SELECT {_DETAIL} FROM checkout_detail WHERE arrival_dt <= {_E} AND departure_dt >= {_S}",
)
def flt_overlap(spark, sf):
    return _detail(rev.filter_overlap(views.checkout_detail(spark, sf), START, END))


@query(
    "flt_status",
    f"SELECT {_DETAIL} FROM checkout_detail WHERE prop_stay_status NOT IN ('N', 'X')",
)
def flt_status(spark, sf):
    return _detail(rev.filter_status(views.checkout_detail(spark, sf)))


@query(
    "flt_same_day",
    f"""SELECT {_DETAIL} FROM checkout_detail WHERE departure_dt >= {_S} + 1
      OR (arrival_dt = {_S} AND departure_dt = {_S})""",
)
def flt_same_day(spark, sf):
    return _detail(rev.filter_same_day(views.checkout_detail(spark, sf), START))


_TXN = """stay_id, folio_id, trans_id, charge_category, entry_type,
  CAST(ledger_entry_amt AS DOUBLE) AS ledger_entry_amt"""


@query(
    "flt_txn",
    f"""SELECT {_TXN} FROM checkout_transaction
    WHERE charge_category <> '' AND charge_category IN ('room', 'food') AND posting_type = 'P'
      AND trans_id IS NOT NULL AND ledger_entry_amt <> 0 AND folio_id = trans_folio_id""",
)
def flt_txn(spark, sf):
    return (
        views.checkout_transaction(spark, sf)
        .filter(rev.can_set_primary_category() & rev.is_own_folio())
        .filter(F.col("charge_category").isin("room", "food"))
        .select(
            "stay_id",
            "folio_id",
            "trans_id",
            "charge_category",
            "entry_type",
            F.col("ledger_entry_amt").cast("double").alias("ledger_entry_amt"),
        )
    )


@query(
    "flt_having",
    f"""WITH {stay_sql('room')} SELECT prop_cd, stay_id, CAST(lc_v4 AS DOUBLE)
      AS chkout_room_lc_amt FROM stays WHERE lc_v4 <> 0""",
)
def flt_having(spark, sf):
    stays = rev.stay_revenue(views.stay_tables(spark, sf), START, END, "room")
    return stays.filter(F.col("lc_v4") != 0).select(
        "prop_cd", "stay_id", F.col("lc_v4").cast("double").alias("chkout_room_lc_amt")
    )


@query(
    "expr_clamp",
    f"""WITH {AMOUNTS} SELECT id, CASE WHEN a > 0 THEN a ELSE 0 END AS clamped FROM amounts""",
)
def expr_clamp(spark, sf):
    return amounts(spark, sf).select(
        "id", F.greatest(F.col("a"), F.lit(0.0)).alias("clamped")
    )


@query(
    "flt_tag",
    """SELECT p_partkey, p_type FROM part WHERE p_type = 'PROMO' AND p_name IS NOT NULL
      AND NOT starts_with(p_brand, 'Brand#1')""",
)
def flt_tag(spark, sf):
    return (
        shape.tagged(views.read(spark, sf, "part"), "PROMO", "p_type")
        .filter(F.col("p_name").isNotNull() & ~F.col("p_brand").startswith("Brand#1"))
        .select("p_partkey", "p_type")
    )


@query(
    "expr_all_in",
    """SELECT o_orderkey, coalesce(o_orderstatus IN ('F', 'O'), false)
        AND coalesce(CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END
          IN ('F', 'O', '5-LOW', '1-URGENT'), false) AS accepted
    FROM orders""",
)
def expr_all_in(spark, sf):
    df = views.read(spark, sf, "orders").withColumn(
        "priority", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority"))
    )
    accepted = ["F", "O", "5-LOW", "1-URGENT"]
    return df.select(
        "o_orderkey", shape.all_in(["o_orderstatus", "priority"], accepted).alias("accepted")
    )
