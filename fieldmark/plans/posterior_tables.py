"""Report tables built from draws and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark import fixed_values as V
from fieldmark.functions import columns as C
from fieldmark.operators.posterior import histogram_density


def named(spark, names: Sequence[str], label: str, index: str) -> DataFrame:
    """Lookup of 1-based positions to names."""
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], f"{index} int, {label} string")


def parameter_lookup(spark) -> DataFrame:
    return spark.createDataFrame(list(V.PARAMETER_LOOKUP), "parameter string, process string, covariate string")


def indexed(df: DataFrame, root: str, first: str, second: str, parameter: str = "parameter") -> DataFrame:
    """Rows of one parameter family with its two indices as columns."""
    return df.where(C.root_of(parameter) == root).withColumns(
        {first: C.index_of(parameter, 1), second: C.index_of(parameter, 2)}
    )


def important_effects(
    summary: DataFrame,
    covariates: DataFrame,
    species: DataFrame,
    indicator: str = "wp",
    effect: str = "betap",
    limit: float = V.IMPORTANT_MEAN,
) -> DataFrame:
    """Mean effect per covariate and species, NULL where the covariate is unimportant."""
    use = indexed(summary, indicator, "covariate_no", "species_no").select(
        "covariate_no", "species_no", C.important("mean", limit).alias("var_use")
    )
    return (
        indexed(summary, effect, "covariate_no", "species_no")
        .select("covariate_no", "species_no", "mean")
        .join(use, ["covariate_no", "species_no"])
        .join(covariates, "covariate_no")
        .join(species, "species_no")
        .select(
            "covariate_no",
            "species_no",
            "covariate",
            "species",
            "var_use",
            (F.col("mean") * F.col("var_use")).alias("mean"),
        )
    )


def important_draws(
    draws: DataFrame,
    summary: DataFrame,
    covariates: DataFrame,
    species: DataFrame,
    indicator: str = "wp",
    effect: str = "betap",
    limit: float = V.IMPORTANT_MEAN,
) -> DataFrame:
    """Long draws of the effects of important covariates, with names.

    Masked rows would be dropped as incomplete, so the unimportant pairs are
    left out of the lookup before the draws are joined to it.
    """
    use = (
        indexed(summary, indicator, "covariate_no", "species_no")
        .where(C.important("mean", limit).isNotNull())
        .select("covariate_no", "species_no")
        .join(covariates, "covariate_no")
        .join(species, "species_no")
    )
    return indexed(draws, effect, "covariate_no", "species_no").join(use, ["covariate_no", "species_no"]).select(
        "chain", "draw_id", "covariate", "species", "value"
    )


def occupied_percent(summary: DataFrame, species: DataFrame, years: DataFrame, n_sites: Column, root: str = "n.occ") -> DataFrame:
    """Percent of sites occupied by year and species with its 95 % bounds."""
    return (
        indexed(summary, root, "year_no", "species_no")
        .join(species, "species_no")
        .join(years, "year_no")
        .select(
            "year",
            "species",
            C.percent_of("mean", n_sites).alias("mean"),
            C.percent_of("q2_5", n_sites).alias("min_ci"),
            C.percent_of("q97_5", n_sites).alias("max_ci"),
        )
    )


def process_density(draws: DataFrame, lookup: DataFrame, width: float = 0.01) -> DataFrame:
    """Histogram density by covariate and process; parameters without a label drop out."""
    labelled = draws.where(F.col("parameter") != "deviance").join(lookup, "parameter")
    return histogram_density(labelled, ["covariate", "process"], width)


def compare_pair(summary: DataFrame, x: str, y: str, key: str, root: str = "family") -> DataFrame:
    """Two parameter families side by side by species: means, mean +/- sd, Rhat product."""

    def side(name: str, suffix: str) -> DataFrame:
        low, high = C.bounds("mean", "sd")
        return summary.where(F.col(root) == name).select(
            key,
            F.col("mean").alias(f"mean_{suffix}"),
            low.alias(f"low_{suffix}"),
            high.alias(f"high_{suffix}"),
            F.col("rhat").alias(f"rhat_{suffix}"),
        )

    return side(x, "x").join(side(y, "y"), key).withColumn("rhat_prod", F.col("rhat_x") * F.col("rhat_y"))


# --- fixed values: regrouping of site-parameter names, in order ---------------
SITE_NAME_RULES = (
    (r"\.site", ""),
    (r"\.0", ".PA_Uncnv"),
    (r"\.1", ".IM_vs_PA"),
    (r"\.2", ".Converted"),
    (r"\.eta", "_eta"),
)


def parameter_families(
    draws: DataFrame,
    detection: Sequence[str] = (r"mu\.d", r"tau\.lp"),
    detection_exact: Sequence[str] = ("alpha.t.p",),
    rules: Sequence[tuple[str, str]] = SITE_NAME_RULES,
) -> DataFrame:
    """Label each draw with its family and the two parts of its (regrouped) name."""
    p = F.col("parameter")
    is_detection = p.isin(*detection_exact)
    for pattern in detection:
        is_detection = is_detection | p.rlike(pattern)
    family = (
        F.when(p.rlike(r"\.site"), "site")
        .when(p.rlike(r"phi\.sp"), "species")
        .when(is_detection, "detection")
        .otherwise("other")
    )
    name = F.when(p.rlike(r"\.site"), C.replaced(p, rules)).otherwise(p)
    return draws.withColumns({"family": family, "__name": name}).withColumns(
        {"part1": C.dotted_part("__name", 1), "part2": C.dotted_part("__name", 2)}
    ).drop("__name")
