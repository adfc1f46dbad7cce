"""Reports that compare revenue between versions and between sources."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeframe.functions.variance import var_bucket
from lodgeframe.operators import revenue as rev
from lodgeframe.operators.aggregates import hierarchy_levels, totals
from lodgeframe.operators.joins import outer_join_all, outer_join_keys
from lodgeframe.operators.shape import rename_versions, select_existing
from lodgeframe.operators.variance import (
    add_variance_columns,
    one_distribution,
    pairwise_variance,
    source_variance_pct,
    variance_distributions,
)
from lodgeframe.sources.scratch import checkpointed

PROPERTY = ["op_area_level2_desc", "country_cd", "country_desc", "prop_cd"]
LEVELS = {
    "country": ["op_area_level2_desc", "country_cd", "country_desc"],
    "op_area_level2_desc": ["op_area_level2_desc"],
}
UNKNOWN = "Unknown"


def compare_levels(
    df_to: DataFrame,
    df_from: DataFrame,
    category: str,
    version_to: str = "v2",
    version_from: str = "v1",
) -> dict[str, DataFrame]:
    """Two property-level extracts compared per property, country, region and in total.

    The coarser levels are summed from the finer ones.
    """
    amount = f"chkout_{category}_usd_amt"
    measures = [
        f"{m} {v}" for m in ("room nights", f"{category} rev") for v in (version_to, version_from)
    ]
    columns = [
        *PROPERTY,
        *[
            f"{m} {x}"
            for m in ("room nights", f"{category} rev")
            for x in (version_to, version_from, "var amt", "var pct")
        ],
    ]

    def finish(df: DataFrame) -> DataFrame:
        return select_existing(
            add_variance_columns(df, category, version_from, version_to), columns
        )

    def sides(df: DataFrame, version: str) -> DataFrame:
        return df.withColumnsRenamed(
            {"room_nights": f"room_nights {version}", amount: f"{amount} {version}"}
        )

    joined = outer_join_keys(sides(df_to, version_to), sides(df_from, version_from), PROPERTY)
    joined = rename_versions(joined, category, [version_to, version_from]).withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in PROPERTY if c != "prop_cd"}
    )
    properties = finish(joined)
    levels = hierarchy_levels(properties, LEVELS, measures, null_dim=UNKNOWN)
    return {
        "total": finish(totals(levels["op_area_level2_desc"], measures)),
        "op_area_level2_desc": finish(levels["op_area_level2_desc"]),
        "country": finish(levels["country"]),
        "prop_cd": properties,
    }


def compare_sources(
    frames: dict[str, DataFrame], hierarchy: DataFrame, measure: str = "room_rev_usd"
) -> dict[str, DataFrame]:
    """Any number of sources compared per property, country and region, with distributions.

    Properties outside the hierarchy are in the property level and the
    distributions, but in no country or region.
    """
    sources = list(frames)
    merged = outer_join_all(frames, "prop_cd").join(hierarchy, "prop_cd", "left")
    measures = [f"{m}_{s}" for m in ("room_nights", measure) for s in sources]
    merged = merged.withColumns({m: F.coalesce(F.col(m), F.lit(0.0)) for m in measures})
    pcts = [f"{measure}_var_pct_{to}_vs_{base}" for base, to in combinations(sources, 2)]
    columns = [*PROPERTY, *measures, *pcts]

    def finish(df: DataFrame) -> DataFrame:
        return select_existing(source_variance_pct(df, measure, sources), columns)

    properties = checkpointed(finish(merged))
    result = {
        "prop_cd": properties.withColumns(
            {f"{p}_distribution": var_bucket(F.col(p)) for p in pcts}
        )
    }
    all_pcts = checkpointed(variance_distributions(properties, pcts))
    for (base, to), pct in zip(combinations(sources, 2), pcts):
        result[f"{to}_vs_{base}_var_pct_dist"] = one_distribution(all_pcts, pct)
    levels = hierarchy_levels(properties, LEVELS, measures, null_dim="drop")
    result["country"] = finish(levels["country"])
    result["op_area_level2_desc"] = finish(levels["op_area_level2_desc"])
    return result


def property_extracts(
    tables: rev.StayTables,
    start: str,
    end: str,
    category: str,
    versions: Sequence[str],
    hierarchy: DataFrame | None = None,
    date_logic: str = "stay",
) -> dict[str, DataFrame]:
    """Property-level extracts of several versions, all cut from one computation.

    The table with one row per property is checkpointed: every extract reads
    it, and none carries the plan that made it.
    """
    stays = rev.stay_revenue(tables, start, end, category, date_logic)
    wide = rev.property_revenue(
        stays, rev.plan_rates(tables.fx_rates), list(versions), "usd"
    )
    if len(versions) == 1:
        wide = wide.withColumnsRenamed(
            {"room_nights": f"room_nights_{versions[0]}", "usd": f"usd_{versions[0]}"}
        )
    if hierarchy is not None:
        wide = wide.join(hierarchy, "prop_cd", "left")
    wide = checkpointed(wide)
    dims = [c for c in PROPERTY if c in wide.columns]
    return {
        v: wide.filter(F.col(f"room_nights_{v}").isNotNull()).select(
            *dims,
            F.col(f"room_nights_{v}").alias("room_nights"),
            F.col(f"usd_{v}").alias(f"chkout_{category}_usd_amt"),
        )
        for v in versions
    }


# The pairs of versions compared reservation by reservation, (to, from).
VERSION_PAIRS = [("v2", "v1"), ("v3", "v1"), ("v3", "v2"), ("v4", "v1")]


def compare_stays(stays: DataFrame, category: str) -> DataFrame:
    """Reservation-level revenue of every version and the variances between them."""
    named = stays.select(
        "prop_cd",
        "stay_id",
        *[F.col(f"lc_{v}").cast("double").alias(f"{category} rev {v}") for v in rev.VERSIONS],
    )
    measures = {v: f"{category} rev {v}" for v in rev.VERSIONS}
    return pairwise_variance(named, measures, VERSION_PAIRS, joiner=" vs ")
