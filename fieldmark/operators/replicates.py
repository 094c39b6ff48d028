"""Replicate numbers, effort and presence per site, period and species.

A visit without a detection row is a zero; a site-year without a visit is
missing.  The visit table is therefore always the left side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.operators.pruning import max_replicates, visit_days
from fieldmark.session import BROADCAST_ROWS, settle, spread


def replicate_numbers(checklists: DataFrame, site: str = "site", across_years: bool = False) -> DataFrame:
    """Rank of each distinct visit day within its site-year (or site).

    A window group holds at most the calendar days of a year (or of the whole
    period), however many lists a site has.
    """
    keys = [site] if across_years else [site, "year"]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("obs_date"))
    return visit_days(checklists, site).withColumn("replicate", order)


def visit_covariates(
    checklists: DataFrame,
    aggregates: dict[str, Column],
    site: str = "site",
    per_species_rows: DataFrame | None = None,
    event: str = "event_id",
) -> DataFrame:
    """One row per site-day with the stated aggregates over its checklists.

    By default a checklist counts once.  With ``per_species_rows`` (a detection
    table) it counts once per detected species, and not at all without one, as
    in a frame joined with detections before grouping.
    """
    rows = checklists
    if per_species_rows is not None:
        rows = rows.join(per_species_rows.select(event), event)
    return rows.groupBy(site, "obs_date").agg(*[c.alias(n) for n, c in aggregates.items()])


def period_effort(
    checklists: DataFrame, sums: Sequence[str], site: str = "cell", period: str = "rep", year: str = "year"
) -> DataFrame:
    """List count and effort sums per site, year and period."""
    return checklists.groupBy(site, year, period).agg(
        F.count("*").alias("n_list"), *[F.sum(c).alias(c) for c in sums]
    )


def period_detections(
    checklists: DataFrame,
    detections: DataFrame,
    site: str = "cell",
    period: str = "rep",
    year: str = "year",
    event: str = "event_id",
) -> DataFrame:
    """Species present per site, year and period (rows only where present)."""
    return (
        checklists.select(event, site, year, period)
        .join(detections.select(event, "species"), event)
        .select(site, year, period, "species")
        .distinct()
        .withColumn("detected", F.lit(1))
    )


def keep_replicated(df: DataFrame, periods: DataFrame, site: str = "cell", year: str = "year", more_than: int = 2) -> DataFrame:
    """Rows of the site-years that have more than so many periods."""
    enough = (
        periods.groupBy(site, year).agg(F.count("*").alias("__n")).where(F.col("__n") > more_than).select(site, year)
    )
    return df.join(enough, [site, year], "left_semi")


def site_day_species(checklists: DataFrame, detections: DataFrame, site: str = "site", event: str = "event_id") -> DataFrame:
    """Distinct (site, year, obs_date, species): presence is the maximum over lists."""
    return (
        checklists.select(event, site, "year", "obs_date")
        .join(detections.select(event, "species"), event)
        .select(site, "year", "obs_date", "species")
        .distinct()
    )


def species_shares(rows: DataFrame, species: DataFrame, share_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each row beside the study species, as sorted arrays ``__names`` of at most about ``share_rows`` names.

    Any taxonomy of usual size is one share, so a row meets one array; a longer
    list is dealt into more shares by a hash, with an equi-join on the share.
    """
    names = species.select("species").where(F.col("species").isNotNull()).distinct()
    shares = max(1, -(-names.count() // share_rows))
    packs = (
        names.groupBy(F.pmod(F.xxhash64("species"), F.lit(shares)).alias("__share"))
        .agg(F.sort_array(F.collect_list("species")).alias("__names"))
    )
    dealt = rows.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return dealt.join(packs, "__share").drop("__share")


def naive_occupancy(
    checklists: DataFrame, detections: DataFrame, species: DataFrame, site: str = "site", event: str = "event_id"
) -> DataFrame:
    """Occupied and surveyed sites per study species and surveyed year, and their ratio.

    A species without a record in a surveyed year has 0 occupied sites there.
    """
    seen = (
        checklists.select(event, site, "year")
        .join(detections.select(event, "species"), event)
        .select(site, "year", "species")
        .distinct()
        .groupBy("species", "year")
        .agg(F.count("*").alias("occupied"))
    )
    surveyed = checklists.select(site, "year").distinct().groupBy("year").agg(F.count("*").alias("surveyed"))
    grid = species_shares(surveyed, species).select("year", "surveyed", F.explode("__names").alias("species"))
    return grid.join(seen, ["species", "year"], "left").select(
        "species",
        "year",
        F.coalesce("occupied", F.lit(0)).alias("occupied"),
        "surveyed",
        (F.coalesce("occupied", F.lit(0)) / F.col("surveyed")).alias("naive_psi"),
    )


def naive_state(checklists: DataFrame, detections: DataFrame, species: DataFrame, site: str = "site", event: str = "event_id") -> DataFrame:
    """Maximum detection over a site-year's replicates for every species: 0 or 1.

    Site-years without a visit have no row, which means unknown.  A site-year
    is reduced to its set of species, map-side first, and only then expanded
    to all species, so the zeros are never shuffled.
    """
    seen = (
        checklists.select(event, site, "year")
        .join(detections.select(event, "species"), event, "left")
        .groupBy(site, "year")
        .agg(F.collect_set("species").alias("__seen"))
    )
    marked = lambda names, z: F.transform(names, lambda s: F.struct(s.alias("species"), F.lit(z).alias("z0")))
    every = F.concat(marked(F.array_intersect("__names", "__seen"), 1), marked(F.array_except("__names", "__seen"), 0))
    return species_shares(seen, species).select(site, "year", F.inline(every))


def dense_panel(sites: DataFrame, years: range, species: DataFrame, site: str = "site") -> DataFrame:
    """Every site x year x species, for callers that need the full array."""
    grid = species_shares(sites.select(site).distinct(), species).withColumn(
        "year", F.explode(F.sequence(F.lit(years.start), F.lit(years.stop - 1)))
    )
    return grid.select(site, "year", F.explode("__names").alias("species"))


def replicate_matrix(
    checklists: DataFrame,
    detections: DataFrame,
    species: DataFrame,
    width: int | None = None,
    site: str = "site",
    event: str = "event_id",
) -> DataFrame:
    """Species x replicate presence per site-year, one column per replicate.

    Replicates that took place hold 0 or 1, later columns stay NULL.  Without
    ``width`` there are as many columns as the busiest site-year has replicates.
    """
    width = width or max_replicates(checklists, site).first()[0] or 0
    history = packed_histories(checklists, detections, species, width, site, event)
    return history.select(
        site, "year", "species", *[F.col("history")[i].alias(f"r{i + 1}") for i in range(width)]
    )


def packed_histories(
    checklists: DataFrame,
    detections: DataFrame,
    species: DataFrame,
    width: int,
    site: str = "site",
    event: str = "event_id",
) -> DataFrame:
    """``history`` array per (site, year, species): 0/1 by replicate, NULL-padded to ``width``.

    A site-year is one row with its days in order (the position of a day is its
    replicate number) and the days of each species seen there; a species that was not seen is the
    same row of zeros.  The species are expanded last.  A site-year with more
    than ``width`` replicates is an error: none is cut off.
    """
    days = (
        spread(visit_days(checklists, site), site, "year")
        .groupBy(site, "year")
        .agg(F.sort_array(F.collect_set("obs_date")).alias("__days"))
    )
    found = site_day_species(checklists, detections, site, event).where(F.col("species").isNotNull())
    hits = (
        spread(found, site, "year")
        .groupBy(site, "year", "species")
        .agg(F.collect_set("obs_date").alias("on"))
        .groupBy(site, "year")
        .agg(F.map_from_entries(F.collect_list(F.struct("species", "on"))).alias("__on"))
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<date>>"))
    rows = species_shares(days.join(hits, [site, "year"], "left").withColumn("__on", F.coalesce("__on", none)), species)
    missing = F.when(F.size("__days") <= width, F.lit(width) - F.size("__days")).otherwise(
        F.raise_error(F.lit(f"a site-year has more than {width} replicates")).cast("int")
    )
    padding = F.array_repeat(F.lit(None).cast("int"), missing)
    seen = F.map_entries(F.map_filter("__on", lambda s, _: F.array_contains("__names", s)))
    history = lambda on: F.concat(F.transform("__days", lambda d: F.array_contains(on, d).cast("int")), padding)
    some = F.transform(seen, lambda e: F.struct(e["key"].alias("species"), history(e["value"]).alias("history")))
    blank = F.concat(F.array_repeat(F.lit(0), F.size("__days")), padding)
    rest = F.transform(
        F.array_except("__names", F.map_keys("__on")), lambda s: F.struct(s.alias("species"), blank.alias("history"))
    )
    return rows.select(site, "year", F.inline(F.concat(some, rest)))


def species_totals(detected: DataFrame, key: str, value: str = "detected") -> DataFrame:
    """Sum over a key of each (site, species) maximum: row or column sums of the presence matrix."""
    return peak_totals(presence_peaks(detected, value), key)


def presence_peaks(detected: DataFrame, value: str = "detected") -> DataFrame:
    """The presence matrix, (site, species) maxima, settled: several sums read it."""
    return settle(detected.groupBy("site", "species").agg(F.max(value).alias("__m")))


def peak_totals(peaks: DataFrame, key: str) -> DataFrame:
    return peaks.groupBy(key).agg(F.sum("__m").alias("n_detected"))
