"""The tables a model run needs, from the cell-by-period form of a survey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators import pruning, relational, scaling
from fieldmark.operators.numbering import surrogate_ids
from fieldmark.session import settle


def model_bundle(
    effort: DataFrame,
    found: DataFrame,
    cells: DataFrame,
    yearly: DataFrame,
    years: range,
    static: Sequence[str],
    changing: Sequence[str],
    more_than: int = 2,
) -> dict[str, DataFrame]:
    """Visit, detection and site tables for ``years``, joined by key.

    ``effort`` has one row per (cell, year, rep), ``found`` one per species
    present there, ``cells`` the static covariates of the region's cells and ``yearly``
    theirs by year.  In this order: cells with more than ``more_than`` surveyed
    years, counted over all years; cells and species that were ever seen; only then the
    stated years; cells with complete covariates.  Static covariates are scaled
    over the region's complete cells, yearly ones year by year, whether or not a
    cell is surveyed.  Sites are numbered in the order of their cells.
    """
    surveyed = pruning.sites_by_years(effort, "cell", "year", more_than).select("cell")
    kept = effort.join(surveyed, "cell", "left_semi")
    seen = settle(found.join(surveyed, "cell", "left_semi").select("cell", "species").distinct())
    kept = kept.join(seen.select("cell").distinct(), "cell", "left_semi").where(F.col("year").isin(*years))

    inside = relational.complete_rows(yearly.where(F.col("year").isin(*years)), ["cell", "year", *changing])
    whole = inside.groupBy("cell").agg(F.count_distinct("year").alias("__n")).where(F.col("__n") == len(years)).select("cell")
    complete = settle(relational.complete_rows(cells, ["cell", *static]).join(whole, "cell", "left_semi"))
    scaled = scaling.zscore_global(complete, list(static)).select("cell", *[F.col(f"{c}_z").alias(c) for c in static])
    by_year = inside.join(complete.select("cell"), "cell", "left_semi")
    moving = scaling.zscore_by(by_year, ["year"], list(changing)).select("cell", "year", *[F.col(f"{c}_z").alias(c) for c in changing])

    kept = settle(kept.join(complete.select("cell"), "cell", "left_semi"))
    sites = settle(surrogate_ids(kept, "cell", "site"))
    index = (F.col("year") - F.lit(years.start - 1)).cast("int").alias("year_index")
    visits = kept.join(sites, "cell").select("site", "cell", "year", index, *[c for c in kept.columns if c not in ("cell", "year")])
    detections = found.join(kept.select("cell", "year", "rep"), ["cell", "year", "rep"], "left_semi").join(sites, "cell")
    return {
        "visits": visits,
        "species": seen.select("species").distinct(),
        "detections": detections.select("site", "cell", "year", "rep", "species"),
        "sites": sites.join(scaled, "cell"),
        "site_years": sites.join(moving, "cell"),
    }
