"""Queries of aggregations, row numbers, report order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgeframe import views
from lodgeframe.catalog.registry import query
from lodgeframe.catalog.revenue import CANDIDATES, TXN, as_text, prop_sql, stay_sql
from lodgeframe.catalog.variance import RATIOS, bucket_sql, ratios
from lodgeframe.functions.variance import BUCKET_ORDER, order_in, var_bucket
from lodgeframe.operators import aggregates as agg
from lodgeframe.operators import revenue as rev
from lodgeframe.operators import sets
from lodgeframe.views import END, START


@query(
    "agg_extract_bounds",
    f"""WITH {CANDIDATES},{TXN} SELECT CAST(lo AS VARCHAR) AS extract_last_update_dtm_min,
      CAST(hi AS VARCHAR) AS extract_last_update_dtm_max FROM bounds""",
)
def agg_extract_bounds(spark, sf):
    bounds = rev.extract_bounds(rev.candidate_stays(views.stay_tables(spark, sf), START, END))
    return as_text(bounds, *bounds.columns)


@query(
    "agg_primary_category",
    """SELECT stay_id, folio_id, trans_id, max(charge_category) AS primary_charge_category
    FROM checkout_transaction WHERE charge_category <> '' AND posting_type = 'P'
      AND trans_id IS NOT NULL AND ledger_entry_amt <> 0 GROUP BY ALL""",
)
def agg_primary_category(spark, sf):
    return rev.primary_category(views.checkout_transaction(spark, sf))


def _filters(spark, sf, category="room"):
    return rev.stay_revenue(views.stay_tables(spark, sf), START, END, category)


@query(
    "agg_rev_filters",
    f"""WITH {stay_sql('tax')} SELECT prop_cd, stay_id, currency_cd AS chckout_currency_cd,
      CAST(rev_filter_1 AS DOUBLE) AS rev_filter_1, CAST(rev_filter_2 AS DOUBLE) AS rev_filter_2,
      CAST(rev_filter_3 AS DOUBLE) AS rev_filter_3 FROM stays""",
)
def agg_rev_filters(spark, sf):
    names = ["rev_filter_1", "rev_filter_2", "rev_filter_3"]
    return _filters(spark, sf, "tax").select(
        "prop_cd",
        "stay_id",
        "chckout_currency_cd",
        *[F.col(n).cast("double").alias(n) for n in names],
    )


@query(
    "agg_sum_filters",
    f"""WITH {stay_sql('room')} SELECT prop_cd, stay_id,
      CAST(rev_filter_1 + rev_filter_2 + rev_filter_3 AS DOUBLE) AS chkout_room_lc_amt
    FROM stays""",
)
def agg_sum_filters(spark, sf):
    return _filters(spark, sf).select(
        "prop_cd", "stay_id", F.col("lc_v4").cast("double").alias("chkout_room_lc_amt")
    )


@query(
    "agg_prop_revenue",
    f"WITH {stay_sql('food')},{prop_sql('v4')} SELECT prop_cd, room_nights, room_rev_usd AS "
    "food_rev_usd FROM props",
)
def agg_prop_revenue(spark, sf):
    rates = rev.plan_rates(views.fx_rates(spark))
    return rev.property_revenue(_filters(spark, sf, "food"), rates, ["v4"], "food_rev_usd")


@query(
    "agg_total",
    """SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS o_totalprice,
      CAST(sum(CAST(o_custkey AS DECIMAL(28,6))) AS DOUBLE) AS o_custkey FROM orders""",
)
def agg_total(spark, sf):
    return agg.totals(views.read(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


_LEVEL_SQL = """
base AS (SELECT stay_id, prop_cd, country_desc, op_area_level2_desc,
  CAST(checkout_detail_key AS DOUBLE) AS measure
  FROM checkout_detail LEFT JOIN prop_hierarchy USING (prop_cd)),
prop AS (SELECT {0} AS op_area_level2_desc, {1} AS country_desc, prop_cd,
  CAST(sum(CAST(measure AS DECIMAL(28,6))) AS DOUBLE) AS measure FROM base GROUP BY ALL),
country AS (SELECT op_area_level2_desc, country_desc,
  CAST(sum(CAST(measure AS DECIMAL(28,6))) AS DOUBLE) AS measure FROM prop GROUP BY ALL),
region AS (SELECT op_area_level2_desc,
  CAST(sum(CAST(measure AS DECIMAL(28,6))) AS DOUBLE) AS measure FROM country GROUP BY ALL)
SELECT 'prop_cd' AS level, * FROM prop
UNION ALL SELECT 'country', op_area_level2_desc, country_desc, NULL, measure FROM country
UNION ALL SELECT 'region', op_area_level2_desc, NULL, NULL, measure FROM region"""


def _hierarchy(spark, sf, null_dim):
    base = (
        views.checkout_detail(spark, sf)
        .join(views.prop_hierarchy(spark, sf), "prop_cd", "left")
        .withColumn("measure", F.col("checkout_detail_key").cast("double"))
    )
    dims = ["op_area_level2_desc", "country_desc", "prop_cd"]
    levels = {"prop_cd": dims, "country": dims[:2], "region": dims[:1]}
    frames = [
        df.withColumn("level", F.lit(name))
        for name, df in agg.hierarchy_levels(base, levels, ["measure"], null_dim).items()
    ]
    return sets.union_diagonal(frames)


@query(
    "agg_hierarchy",
    "WITH "
    + _LEVEL_SQL.format(
        "coalesce(op_area_level2_desc, 'Unknown')", "coalesce(country_desc, 'Unknown')"
    ),
)
def agg_hierarchy(spark, sf):
    return _hierarchy(spark, sf, "Unknown")


@query(
    "agg_hierarchy_drop",
    "WITH "
    + _LEVEL_SQL.format("op_area_level2_desc", "country_desc").replace(
        "FROM base GROUP", "FROM base WHERE op_area_level2_desc IS NOT NULL "
        "AND country_desc IS NOT NULL GROUP", 1
    ),
)
def agg_hierarchy_drop(spark, sf):
    return _hierarchy(spark, sf, "drop")


@query(
    "agg_distribution",
    """SELECT event_type, count(*) AS distribution_count,
      round(count(*) / (SELECT count(*) FROM events), 6) AS "distribution_count_%_total"
    FROM events WHERE event_type IS NOT NULL GROUP BY 1""",
)
def agg_distribution(spark, sf):
    share = "distribution_count_%_total"
    counted = agg.distribution(views.read(spark, sf, "events"), "event_type")
    return counted.withColumn(share, F.round(F.col(share), 6))


@query(
    "agg_dynamic_groupby",
    """SELECT o_custkey, o_orderstatus, o_orderpriority,
      CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS o_totalprice
    FROM orders GROUP BY ALL""",
)
def agg_dynamic_groupby(spark, sf):
    orders = views.read(spark, sf, "orders").drop("o_orderkey", "o_orderdate")
    return agg.sum_by_rest(orders, ["o_totalprice"])


@query(
    "agg_distinct_pairs",
    "SELECT DISTINCT prop_cd, currency_cd FROM checkout_detail",
)
def agg_distinct_pairs(spark, sf):
    return agg.distinct_pairs(views.checkout_detail(spark, sf), ["prop_cd", "currency_cd"])


@query(
    "win_row_number",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY event_type
      ORDER BY user_id, event_id) AS row_num FROM events""",
)
def win_row_number(spark, sf):
    events = views.read(spark, sf, "events").select("event_id", "user_id", "event_type")
    return sets.number_rows(events, ["user_id", "event_id"], ["event_type"]).drop("event_type")


@query(
    "win_global_row_number",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_num "
    "FROM orders",
)
def win_global_row_number(spark, sf):
    orders = views.read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sets.number_rows(orders, ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@query(
    "win_first_with_len",
    """SELECT lang, min_by(text, (length(text), text)) AS shortest FROM documents GROUP BY lang""",
)
def win_first_with_len(spark, sf):
    documents = views.read(spark, sf, "documents")
    return sets.first_of_length(documents, ["lang"], "text", F.length("text"), "shortest")


@query(
    "sort_custom_order",
    f"""WITH {RATIOS} SELECT id, {bucket_sql('pct')} AS bucket,
      CAST(coalesce(list_position({BUCKET_ORDER!r}, bucket), {len(BUCKET_ORDER) + 1}) AS INTEGER)
        AS place
    FROM ratios""",
)
def sort_custom_order(spark, sf):
    bucketed = ratios(spark, sf).select("id", var_bucket(F.col("pct")).alias("bucket"))
    placed = bucketed.withColumn("place", order_in(BUCKET_ORDER, F.col("bucket")))
    return sets.sort_custom(placed, "bucket", BUCKET_ORDER)


@query(
    "set_union_all",
    """SELECT s_suppkey AS id, s_name AS name FROM supplier
    UNION ALL SELECT c_custkey, c_name FROM customer
    UNION ALL SELECT p_partkey, p_name FROM part""",
)
def set_union_all(spark, sf):
    frames = [
        views.read(spark, sf, table).select(F.col(f"{p}key").alias("id"), F.col(n).alias("name"))
        for table, p, n in [
            ("supplier", "s_supp", "s_name"),
            ("customer", "c_cust", "c_name"),
            ("part", "p_part", "p_name"),
        ]
    ]
    return sets.union_all(frames)


@query(
    "set_union_diagonal",
    """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS brand FROM supplier
    UNION ALL SELECT p_partkey, NULL, NULL, p_brand FROM part""",
)
def set_union_diagonal(spark, sf):
    supplier = views.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
    )
    part = views.read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")
    )
    return sets.union_diagonal([supplier, part])


@query(
    "reshape_transpose",
    """SELECT 'rows' AS metric, 'o_orderkey' AS field, count(o_orderkey) AS value FROM orders
    UNION ALL SELECT 'rows', 'o_custkey', count(o_custkey) FROM orders
    UNION ALL SELECT 'max', 'o_orderkey', max(o_orderkey) FROM orders
    UNION ALL SELECT 'max', 'o_custkey', max(o_custkey) FROM orders""",
)
def reshape_transpose(spark, sf):
    orders = views.read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    names = orders.columns
    both = orders.agg(
        F.inline(
            F.array(
                F.struct(F.lit("rows").alias("metric"), *[F.count(c).alias(c) for c in names]),
                F.struct(F.lit("max").alias("metric"), *[F.max(c).alias(c) for c in names]),
            )
        )
    )
    return sets.transpose_metrics(both, "metric")
