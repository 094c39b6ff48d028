"""Keep well-surveyed sites and well-recorded species.

All rules are hash aggregates on keys, so a site that holds most of the rows is
reduced to its distinct visit days before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark import fixed_values as V
from fieldmark.session import checked_broadcast, settle


def in_season(
    months: Sequence[int] = V.SEASON_MONTHS,
    protocols: Sequence[str] = V.PROTOCOLS,
    primary: object = V.PRIMARY_FLAG,
    states: Sequence[object] | None = None,
    first_year: int | None = None,
    last_year: int | None = None,
    month: str = "month",
    protocol: str = "count_type",
    flag: str = "primary_checklist_flag",
    state: str = "state_province",
    year: str = "year",
) -> Column:
    """The checklist predicate: season, protocol, primary list, region, years."""
    keep = F.col(month).isin(*months) & F.col(protocol).isin(*protocols) & (F.col(flag) == primary)
    if states is not None:
        keep = keep & F.col(state).isin(*states)
    if first_year is not None:
        keep = keep & (F.col(year) >= first_year)
    if last_year is not None:
        keep = keep & (F.col(year) <= last_year)
    return keep


def visit_days(checklists: DataFrame, site: str = "site") -> DataFrame:
    """Distinct (site, year, obs_date): one replicate per day."""
    return checklists.select(site, "year", "obs_date").distinct()


def site_year_replicates(checklists: DataFrame, site: str = "site") -> DataFrame:
    return visit_days(checklists, site).groupBy(site, "year").agg(F.count("*").alias("reps"))


def well_surveyed_sites(
    checklists: DataFrame,
    site: str = "site",
    min_replicates: int = V.MIN_REPLICATES,
    min_years: int = V.MIN_YEARS,
) -> DataFrame:
    """Sites with enough replicates in enough years."""
    reps = site_year_replicates(checklists, site)
    return (
        reps.where(F.col("reps") >= min_replicates)
        .groupBy(site)
        .agg(F.count("*").alias("n_years"))
        .where(F.col("n_years") >= min_years)
    )


def sites_by_years(df: DataFrame, site: str = "site", year: str = "year", more_than: int = 2) -> DataFrame:
    """Sites with rows in more than ``more_than`` distinct years."""
    return (
        df.select(site, year)
        .distinct()
        .groupBy(site)
        .agg(F.count("*").alias("n_years"))
        .where(F.col("n_years") > more_than)
    )


def groups_above(df: DataFrame, keys: Sequence[str], at_least: int | Column, name: str = "n_rows") -> DataFrame:
    """Groups with at least so many rows (a number, or a scalar such as a share of a table)."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) >= at_least)


def species_with_records(detections: DataFrame, min_records: int | Column = V.MIN_RECORDS) -> DataFrame:
    return groups_above(detections, ["species"], min_records, "n_records")


def max_replicates(checklists: DataFrame, site: str = "site") -> DataFrame:
    return site_year_replicates(checklists, site).agg(F.max("reps").alias("max_rep"))


def drop_unseen(detected: DataFrame, site: str = "site", value: str = "detected") -> DataFrame:
    """Drop species never detected anywhere and sites where no study species was.

    The facts are reduced to the (site, species) pairs seen, which are settled and
    give both key lists; the facts are then read once more, and move by site only.
    """
    seen = settle(detected.where(F.col(value) > 0).select(site, "species").distinct())
    species = checked_broadcast(seen.select("species").distinct())
    return detected.join(species, "species", "left_semi").join(seen.select(site).distinct(), site, "left_semi").select(*detected.columns)


def dimension_sizes(df: DataFrame, **dims: str) -> DataFrame:
    """Row count and distinct counts of the named columns, as one row.

    Each distinct count runs on its own de-duplicated column (map-side
    combined), instead of one plan that repeats every row per column.
    """
    parts = [df.agg(F.count("*").alias("n")).select(F.lit("n_rows").alias("dimension"), "n")]
    for name, column in dims.items():
        one = df.select(column).where(F.col(column).isNotNull()).distinct().agg(F.count("*").alias("n"))
        parts.append(one.select(F.lit(name).alias("dimension"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
