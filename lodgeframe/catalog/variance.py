"""Queries of variance columns and version comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodgeframe import views
from lodgeframe.catalog.registry import query
from lodgeframe.catalog.revenue import prop_sql, stay_sql
from lodgeframe.functions import variance as fv
from lodgeframe.operators import revenue as rev
from lodgeframe.operators.variance import (
    add_variance_columns,
    pairwise_variance,
    variance_distribution,
    variance_distributions,
)
from lodgeframe.plans import comparison
from lodgeframe.views import END, START

# Two amounts per order, from the data: negative, zero and missing ones included.
AMOUNTS = """
amounts AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL
      ELSE CAST(o_custkey % 7 - 3 AS DOUBLE) * 10 END AS a,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL
      ELSE CAST(o_orderkey % 9 - 4 AS DOUBLE) * 7 END AS b
  FROM orders)"""


def amounts(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return views.read(spark, sf, "orders").select(
        key.alias("id"),
        F.when(key % 11 != 0, (cust % 7 - 3).cast("double") * 10).alias("a"),
        F.when(key % 13 != 0, (key % 9 - 4).cast("double") * 7).alias("b"),
    )


def pct_sql(var: str, base: str) -> str:
    return f"""CASE WHEN {base} = 0 AND {var} = 0 THEN 0.0::DOUBLE
      WHEN {base} = 0 AND {var} > 0 THEN 1.0::DOUBLE WHEN {base} = 0 AND {var} < 0 THEN -1.0::DOUBLE
      WHEN {base} < 0 THEN -({var}) / {base} WHEN {base} > 0 THEN ({var}) / {base} END"""


def null_aware_sql(missing_from: str) -> str:
    return f"""CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL THEN {missing_from}
      WHEN b IS NULL THEN -1.0::DOUBLE WHEN a = 0 AND b = 0 THEN 0.0::DOUBLE
      WHEN a = 0 THEN 1.0::DOUBLE ELSE (b - a) / a END"""


def bucket_sql(x: str) -> str:
    edges = [-100, -90, -80, -70, -60, -50, -40, -30, -20, -10, -8, -6, -4, -2, 0]
    edges += [2, 4, 6, 8, 10, 20, 30, 40, 50, 60, 70, 80, 90]
    tests = " ".join(
        f"WHEN {x} > {lo / 100}::DOUBLE AND {x} <= {hi / 100}::DOUBLE "
        f"THEN 'between {lo}% and {hi}%'"
        for lo, hi in zip(edges, edges[1:])
    )
    return f"""CASE WHEN {x} < -1 THEN '< -100%' WHEN {x} = -1 THEN 'equals -100%' {tests}
      WHEN {x} > 0.9::DOUBLE AND {x} < 1 THEN 'between 90% and 100%'
      WHEN {x} = 1 THEN 'equals 100%' WHEN {x} > 1 THEN '> 100%' END"""


def _pct(column):
    return F.round(column, 6)


@query("var_pct", f"WITH {AMOUNTS} SELECT id, round({pct_sql('a', 'b')}, 6) AS pct FROM amounts")
def var_pct(spark, sf):
    return amounts(spark, sf).select("id", _pct(fv.var_pct(F.col("a"), F.col("b"))).alias("pct"))


@query(
    "var_pct_from_to",
    f"WITH {AMOUNTS} SELECT id, round({pct_sql('b - a', 'a')}, 6) AS pct FROM amounts",
)
def var_pct_from_to(spark, sf):
    pct = fv.var_pct_from_to(F.col("a"), F.col("b"))
    return amounts(spark, sf).select("id", _pct(pct).alias("pct"))


@query(
    "var_pct_null_aware",
    f"WITH {AMOUNTS} SELECT id, round({null_aware_sql('1.0::DOUBLE')}, 6) AS pct FROM amounts",
)
def var_pct_null_aware(spark, sf):
    pct = fv.var_pct_null_aware(F.col("a"), F.col("b"))
    return amounts(spark, sf).select("id", _pct(pct).alias("pct"))


@query(
    "var_pct_null_aware_alt",
    f"WITH {AMOUNTS} SELECT id, round({null_aware_sql('b * -1')}, 6) AS pct FROM amounts",
)
def var_pct_null_aware_alt(spark, sf):
    pct = fv.var_pct_null_aware(F.col("a"), F.col("b"), missing_from="neg_to")
    return amounts(spark, sf).select("id", _pct(pct).alias("pct"))


@query(
    "var_same_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN (s.l_returnflag IS NULL) <> (t.l_returnflag IS NULL) THEN 'variance' END
        AS flag_variance,
      CASE WHEN (s.l_returnflag IS NULL) <> (t.l_returnflag IS NULL)
        OR lower(s.l_returnflag) <> lower(t.l_returnflag) THEN 'variance' END
        AS flag_variance_strict
    FROM lineitem_source s JOIN lineitem_target t
      USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""",
)
def var_same_text(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    target = views.lineitem_target(spark, sf).select(*keys, F.col("l_returnflag").alias("t"))
    s, t = F.col("l_returnflag"), F.col("t")
    return (
        views.lineitem_source(spark, sf)
        .join(target, keys)
        .select(
            *keys,
            fv.same_text(s, t).alias("flag_variance"),
            fv.same_text(s, t, strict=True).alias("flag_variance_strict"),
        )
    )


# A ratio per order, with exact bucket edges among its values.
RATIOS = """
ratios AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN NULL
  ELSE CAST(o_orderkey % 131 - 65 AS DOUBLE) / 50 END AS pct FROM orders)"""


def ratios(spark, sf):
    key = F.col("o_orderkey")
    return views.read(spark, sf, "orders").select(
        key.alias("id"),
        F.when(key % 17 != 0, (key % 131 - 65).cast("double") / 50).alias("pct"),
    )


@query("var_bucket", f"WITH {RATIOS} SELECT id, {bucket_sql('pct')} AS bucket FROM ratios")
def var_bucket(spark, sf):
    return ratios(spark, sf).select("id", fv.var_bucket(F.col("pct")).alias("bucket"))


@query(
    "var_distribution",
    f"""WITH {RATIOS} SELECT {bucket_sql('pct')} AS pct_distribution,
      count(*) AS distribution_count,
      round(count(*) / (SELECT count(*) FROM ratios), 6) AS "distribution_count_%_total"
    FROM ratios WHERE pct IS NOT NULL GROUP BY 1""",
)
def var_distribution(spark, sf):
    share = "distribution_count_%_total"
    return variance_distribution(ratios(spark, sf), "pct").withColumn(
        share, F.round(F.col(share), 6)
    )


VERSIONED = """
versioned AS (SELECT id, a AS "room nights v1", b AS "room nights v2",
  a * 3 AS "room rev v1", b * 2 AS "room rev v2" FROM amounts)"""


def versioned(spark, sf):
    a, b = F.col("a"), F.col("b")
    return amounts(spark, sf).select(
        "id",
        a.alias("room nights v1"),
        b.alias("room nights v2"),
        (a * 3).alias("room rev v1"),
        (b * 2).alias("room rev v2"),
    )


def variance_columns_sql(category: str, to: str, base: str) -> str:
    parts = []
    for m in ("room nights", f"{category} rev"):
        t, f = f'"{m} {to}"', f'"{m} {base}"'
        amount = pct_sql(f"({t} - {f})", f)
        parts.append(
            f'{t}, {f}, round({t} - {f}, 6) AS "{m} var amt", round({amount}, 6) AS "{m} var pct"'
        )
    return ", ".join(parts)


def rounded(df):
    """Ratios and differences to six places."""
    ends = ("var amt", "var pct")
    return df.withColumns(
        {c: F.round(F.col(f"`{c}`"), 6) for c in df.columns if c.endswith(ends) or "_pct_" in c}
    )


@query(
    "var_add_columns",
    f"""WITH {AMOUNTS}, {VERSIONED},
    filled AS (SELECT id, coalesce("room nights v1", 0) AS "room nights v1",
      coalesce("room nights v2", 0) AS "room nights v2",
      coalesce("room rev v1", 0) AS "room rev v1",
      coalesce("room rev v2", 0) AS "room rev v2" FROM versioned)
    SELECT id, {variance_columns_sql('room', 'v2', 'v1')} FROM filled""",
)
def var_add_columns(spark, sf):
    return rounded(add_variance_columns(versioned(spark, sf), "room", "v1", "v2"))


_PAIRS = [("v1", "v2"), ("v1", "v3"), ("v1", "v4"), ("v2", "v3"), ("v2", "v4"), ("v3", "v4")]


def _pair_sql(pairs, joiner: str) -> str:
    return ", ".join(
        f'round(CAST(lc_{t} - lc_{f} AS DOUBLE), 6) AS "{t}{joiner}{f} var amt", '
        f'round({pct_sql(f"CAST(lc_{t} - lc_{f} AS DOUBLE)", f"CAST(lc_{f} AS DOUBLE)")}, 6) '
        f'AS "{t}{joiner}{f} var pct"'
        for t, f in pairs
    )


@query(
    "var_pairwise",
    f"WITH {stay_sql('room')} SELECT prop_cd, stay_id, {_pair_sql(_PAIRS, ' vs. ')} FROM stays",
)
def var_pairwise(spark, sf):
    stays = rev.stay_revenue(views.stay_tables(spark, sf), START, END, "room")
    named = stays.select(
        "prop_cd", "stay_id", *[F.col(f"lc_{v}").cast("double").alias(v) for v in rev.VERSIONS]
    )
    pairs = pairwise_variance(named, {v: v for v in rev.VERSIONS})
    return rounded(pairs.drop(*rev.VERSIONS))


@query(
    "var_stay_versions",
    f"""WITH {stay_sql('food')} SELECT prop_cd, stay_id,
      {", ".join(f'CAST(lc_{v} AS DOUBLE) AS "food rev {v}"' for v in rev.VERSIONS)},
      {_pair_sql(comparison.VERSION_PAIRS, ' vs ')} FROM stays""",
)
def var_stay_versions(spark, sf):
    stays = rev.stay_revenue(views.stay_tables(spark, sf), START, END, "food")
    return rounded(comparison.compare_stays(stays, "food"))


# Property extracts of two versions with their hierarchy, joined as a report does.
EXTRACTS = f"""{stay_sql('room')},{prop_sql('v1', 'p1')},{prop_sql('v4', 'p4')},
e1 AS (SELECT p.*, h.* EXCLUDE (prop_cd) FROM p1 p LEFT JOIN prop_hierarchy h USING (prop_cd)),
e4 AS (SELECT p.*, h.* EXCLUDE (prop_cd) FROM p4 p LEFT JOIN prop_hierarchy h USING (prop_cd)),
joined AS (
  SELECT coalesce(a.prop_cd, b.prop_cd) AS prop_cd,
    coalesce(CAST(coalesce(a.country_cd, b.country_cd) AS VARCHAR), 'Unknown') AS country_cd,
    coalesce(a.country_desc, b.country_desc, 'Unknown') AS country_desc,
    coalesce(a.op_area_level2_desc, b.op_area_level2_desc, 'Unknown') AS op_area_level2_desc,
    coalesce(a.room_nights, 0) AS "room nights v4", coalesce(b.room_nights, 0) AS "room nights v1",
    coalesce(a.room_rev_usd, 0) AS "room rev v4", coalesce(b.room_rev_usd, 0) AS "room rev v1"
  FROM e4 a FULL JOIN e1 b ON a.prop_cd IS NOT DISTINCT FROM b.prop_cd
    AND a.country_cd IS NOT DISTINCT FROM b.country_cd
    AND a.country_desc IS NOT DISTINCT FROM b.country_desc
    AND a.op_area_level2_desc IS NOT DISTINCT FROM b.op_area_level2_desc)"""

_SUMS = ", ".join(
    f'CAST(sum(CAST("{m}" AS DECIMAL(28,6))) AS DOUBLE) AS "{m}"'
    for m in ("room nights v4", "room nights v1", "room rev v4", "room rev v1")
)
LEVELS = f"""{EXTRACTS},
country AS (SELECT op_area_level2_desc, country_cd, country_desc, {_SUMS} FROM joined GROUP BY ALL),
region AS (SELECT op_area_level2_desc, {_SUMS} FROM country GROUP BY ALL),
total AS (SELECT {_SUMS} FROM region)"""


def level_union_sql() -> str:
    dims = ["op_area_level2_desc", "country_cd", "country_desc", "prop_cd"]
    known = {"total": 0, "region": 1, "country": 3, "joined": 4}
    names = {"total": "total", "region": "op_area_level2_desc", "country": "country"}
    return " UNION ALL ".join(
        f"SELECT '{names.get(t, 'prop_cd')}' AS level, "
        + ", ".join(d if i < n else f"NULL AS {d}" for i, d in enumerate(dims))
        + f", {variance_columns_sql('room', 'v4', 'v1')} FROM {t}"
        for t, n in known.items()
    )


def room_extracts(spark, sf, versions=("v1", "v4")):
    return comparison.property_extracts(
        views.stay_tables(spark, sf), START, END, "room", versions,
        views.prop_hierarchy(spark, sf),
    )


@query("var_compare_levels", f"WITH {LEVELS} {level_union_sql()}")
def var_compare_levels(spark, sf):
    extracts = room_extracts(spark, sf)
    levels = comparison.compare_levels(extracts["v4"], extracts["v1"], "room", "v4", "v1")
    dims = comparison.PROPERTY
    frames = [
        df.select(
            F.lit(name).alias("level"),
            *[F.col(d) if d in df.columns else F.lit(None).cast("string").alias(d) for d in dims],
            *[f"`{c}`" for c in df.columns if c not in dims],
        )
        for name, df in levels.items()
    ]
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f)
    return rounded(result)


_SOURCES = ["v1", "v2", "v3", "v4"]
_SOURCE_PAIRS = [(b, t) for i, b in enumerate(_SOURCES) for t in _SOURCES[i + 1 :]]
MERGED = f"""{stay_sql('room')},{",".join(prop_sql(v, "p" + v) for v in _SOURCES)},
ids AS (SELECT prop_cd FROM pv1 UNION SELECT prop_cd FROM pv2 UNION SELECT prop_cd FROM pv3
  UNION SELECT prop_cd FROM pv4),
merged AS (
  SELECT prop_cd, op_area_level2_desc, CAST(country_cd AS VARCHAR) AS country_cd, country_desc,
    {", ".join(f"coalesce(p{v}.room_nights, 0) AS room_nights_{v}, "
               f"coalesce(p{v}.room_rev_usd, 0) AS room_rev_usd_{v}" for v in _SOURCES)}
  FROM ids {" ".join(f"LEFT JOIN p{v} USING (prop_cd)" for v in _SOURCES)}
    LEFT JOIN prop_hierarchy USING (prop_cd))"""
_SOURCE_SUMS = ", ".join(
    f"CAST(sum(CAST({m}_{v} AS DECIMAL(28,6))) AS DOUBLE) AS {m}_{v}"
    for m in ("room_nights", "room_rev_usd")
    for v in _SOURCES
)


def _source_pct_sql() -> str:
    return ", ".join(
        "round("
        + pct_sql(f"(room_rev_usd_{t} - room_rev_usd_{b})", f"room_rev_usd_{b}")
        + f", 6) AS room_rev_usd_var_pct_{t}_vs_{b}"
        for b, t in _SOURCE_PAIRS
    )


_MEASURES = ", ".join(f"{m}_{v}" for m in ("room_nights", "room_rev_usd") for v in _SOURCES)


def _sources(spark, sf):
    extracts = room_extracts_plain(spark, sf)
    return comparison.compare_sources(extracts, views.prop_hierarchy(spark, sf))


def room_extracts_plain(spark, sf):
    """Extracts with property, nights and revenue only."""
    extracts = comparison.property_extracts(
        views.stay_tables(spark, sf), START, END, "room", _SOURCES
    )
    return {
        v: df.withColumnRenamed("chkout_room_usd_amt", "room_rev_usd")
        for v, df in extracts.items()
    }


@query(
    "var_compare_sources",
    f"""WITH {MERGED},
    country AS (SELECT op_area_level2_desc, country_cd, country_desc, {_SOURCE_SUMS} FROM merged
      WHERE op_area_level2_desc IS NOT NULL AND country_cd IS NOT NULL AND country_desc IS NOT NULL
      GROUP BY ALL),
    region AS (SELECT op_area_level2_desc, {_SOURCE_SUMS} FROM country GROUP BY ALL)
    SELECT 'prop_cd' AS level, op_area_level2_desc, country_cd, country_desc, prop_cd,
      {_MEASURES}, {_source_pct_sql()} FROM merged
    UNION ALL SELECT 'country', op_area_level2_desc, country_cd, country_desc, NULL,
      {_MEASURES}, {_source_pct_sql()} FROM country
    UNION ALL SELECT 'op_area_level2_desc', op_area_level2_desc, NULL, NULL, NULL,
      {_MEASURES}, {_source_pct_sql()} FROM region""",
)
def var_compare_sources(spark, sf):
    reports = _sources(spark, sf)
    dims = comparison.PROPERTY
    result = None
    for name in ("prop_cd", "country", "op_area_level2_desc"):
        df = reports[name]
        part = df.select(
            F.lit(name).alias("level"),
            *[
                (F.col(d).cast("string") if d in df.columns else F.lit(None).cast("string")).alias(d)
                for d in dims
            ],
            *[c for c in df.columns if c not in dims and not c.endswith("_distribution")],
        )
        result = part if result is None else result.unionByName(part)
    return rounded(result)


@query(
    "var_source_distributions",
    f"""WITH {MERGED}, pcts AS (
      {" UNION ALL ".join(
          f"SELECT '{t}_vs_{b}' AS pair, "
          + pct_sql(f"(room_rev_usd_{t} - room_rev_usd_{b})", f"room_rev_usd_{b}")
          + " AS pct FROM merged" for b, t in _SOURCE_PAIRS)})
    SELECT pair, {bucket_sql('pct')} AS bucket, count(*) AS distribution_count,
      round(count(*) / (SELECT count(*) FROM merged), 6) AS "distribution_count_%_total"
    FROM pcts WHERE pct IS NOT NULL GROUP BY ALL""",
)
def var_source_distributions(spark, sf):
    pcts = [f"room_rev_usd_var_pct_{t}_vs_{b}" for b, t in _SOURCE_PAIRS]
    share = "distribution_count_%_total"
    return variance_distributions(_sources(spark, sf)["prop_cd"], pcts).select(
        F.replace(F.col("pct"), F.lit("room_rev_usd_var_pct_"), F.lit("")).alias("pair"),
        "bucket",
        "distribution_count",
        F.round(F.col(share), 6).alias(share),
    )
