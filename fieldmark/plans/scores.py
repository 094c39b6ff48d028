"""Linear predictors of the occupancy models as column expressions.

Coefficient tables have one row per species.  They are carried as one array
value and expanded beside each visit or site-year, so the facts are not
shuffled and no join produces pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import inv_logit
from fieldmark.session import BROADCAST_ROWS, checked_broadcast, settle


def per_species(df: DataFrame, coefficients: DataFrame, max_species: int = BROADCAST_ROWS) -> DataFrame:
    """Each row of ``df`` once per row of the coefficient table."""
    table = settle(coefficients)
    if table.count() > max_species:
        # Too many for one array: deal the coefficients into shares and let
        # every fact visit each share, an equi-join that Spark can spread.
        shares = -(-table.count() // max_species)
        dealt = table.withColumn("__share", F.pmod(F.xxhash64(*table.columns), F.lit(shares)))
        packs = dealt.groupBy("__share").agg(F.collect_list(F.struct(*table.columns)).alias("__pack"))
        spread = df.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn(
            "__share", F.col("__share").cast("long")
        )
        return spread.join(packs, "__share").select(*df.columns, F.inline("__pack"))
    pack = table.agg(F.collect_list(F.struct(*table.columns)).alias("p")).scalar()
    return df.select(*df.columns, F.inline(pack))


def linear(intercept: Column, terms: Mapping[str, Column]) -> Column:
    """intercept + sum of coefficient column x value."""
    return reduce(lambda a, t: a + F.col(t[0]) * t[1], terms.items(), intercept)


def detection_score(
    visits: DataFrame,
    year_intercepts: DataFrame,
    coefficients: DataFrame,
    terms: Mapping[str, str],
    ids: Sequence[str] = ("event_id", "site", "year"),
) -> DataFrame:
    """Detection probability per visit and species.

    logit p = year intercept (``palpha``) + sum of species slope x visit
    covariate; ``terms`` maps slope columns to covariate columns.
    """
    used = [*dict.fromkeys([*ids, "year", *terms.values()])]
    rows = per_species(visits.select(*used).join(checked_broadcast(year_intercepts), "year"), coefficients)
    p = inv_logit(linear(F.col("palpha"), {b: F.col(x).cast("double") for b, x in terms.items()}))
    return rows.select(*ids, "species", p.alias("p"))


def weighted_detection_score(
    visits: DataFrame,
    coefficients: DataFrame,
    covariates: Sequence[str],
    ids: Sequence[str] = ("event_id",),
    intercepts: DataFrame | None = None,
) -> DataFrame:
    """Detection probability with 0/1 covariate weights.

    ``coefficients`` is long: (species, covariate, weight, beta).  It is turned
    to one row per species, so that a visit's sum is one expression.
    ``intercepts`` (species, alpha) adds each species' own level; without it, or for a
    species that it lacks, the level is 0.
    """
    wide = coefficients.groupBy("species").agg(
        *[
            F.sum(F.when(F.col("covariate") == c, F.col("weight") * F.col("beta")).otherwise(0.0)).alias(f"__b_{c}")
            for c in covariates
        ]
    )
    alpha = F.coalesce(F.col("alpha").cast("double"), F.lit(0.0)).alias("__alpha")
    if intercepts is None:
        wide = wide.withColumn("__alpha", F.lit(0.0))
    else:
        wide = wide.join(intercepts.select("species", alpha), "species", "left").fillna(0.0, ["__alpha"])
    rows = per_species(visits.select(*ids, *[F.col(c).cast("double").alias(c) for c in covariates]), wide)
    return rows.select(
        *ids, "species", inv_logit(linear(F.col("__alpha"), {f"__b_{c}": F.col(c) for c in covariates})).alias("p")
    )


def with_prior_year(panel: DataFrame, columns: Sequence[str], site: str = "site") -> DataFrame:
    """Add ``<column>_prev`` from the year before; a gap in the years gives NULL.

    A window group is one site's yearly rows.
    """
    w = Window.partitionBy(site).orderBy("year")
    previous = F.lag("year").over(w) == F.col("year") - 1
    return panel.withColumns({f"{c}_prev": F.when(previous, F.lag(c).over(w)) for c in columns})


def transition_scores(
    panel: DataFrame,
    coefficients: DataFrame,
    static: Sequence[str],
    yearly: Sequence[str],
    products: Sequence[tuple[str, str]] = (),
    constant_gamma: bool = False,
    site: str = "site",
) -> DataFrame:
    """Persistence and colonisation per species, site and year.

    Static covariates enter as they are; yearly ones at t - 1 for persistence
    and at t for colonisation; ``products`` are (static, yearly) interactions.
    Coefficients are named ``phi_0``, ``phi_<covariate>``, ``phi_<a>_<b>`` and
    likewise ``gamma_``.  With ``constant_gamma`` colonisation has only its
    intercept (per species).
    """
    rows = per_species(with_prior_year(panel, yearly, site), coefficients)

    def terms(prefix: str, suffix: str) -> dict[str, Column]:
        out = {f"{prefix}_{c}": F.col(c) for c in static}
        out.update({f"{prefix}_{c}": F.col(f"{c}{suffix}") for c in yearly})
        out.update({f"{prefix}_{a}_{b}": F.col(a) * F.col(f"{b}{suffix}") for a, b in products})
        return out

    gamma_terms = {} if constant_gamma else terms("gamma", "")
    return rows.select(
        site,
        "year",
        "species",
        inv_logit(linear(F.col("phi_0"), terms("phi", "_prev"))).alias("phi"),
        inv_logit(linear(F.col("gamma_0"), gamma_terms)).alias("gamma"),
    )


def trait_coefficients(
    species_traits: DataFrame, trait_table: DataFrame, key: str = "trait", own: DataFrame | None = None
) -> DataFrame:
    """Species rows with the slopes of their trait group and, from ``own``, what stays per species (intercepts)."""
    rows = species_traits.join(trait_table, key)
    return rows if own is None else rows.join(own, "species")


def trait_means(coefficients: DataFrame, species_traits: DataFrame, columns: Sequence[str], key: str = "trait") -> DataFrame:
    """Group means of species coefficients: what the shared prior of a group centres on."""
    return coefficients.join(species_traits, "species").groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
