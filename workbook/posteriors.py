"""Draws: summaries, convergence, densities and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark import fixed_values as V
from fieldmark.functions import columns as C
from fieldmark.operators import posterior, relational
from fieldmark.plans import posterior_tables as P
from workbook import standins as S
from workbook.registry import query, rounded

# --- fixed values: labels of the two species axes of the draws ---------------
DRAW_SPECIES = ("Brand#1", "Brand#2")
STATS = ("mean", "sd", "q2_5", "q25", "q50", "q75", "q97_5")

COVARIATE_NAMES = "covariates(covariate_no, covariate) as (values " + ", ".join(
    f"({i + 1}, '{n}')" for i, n in enumerate(V.DETECTION_COVARIATES)
) + ")"
SPECIES_NAMES = "names(species_no, species) as (values " + ", ".join(
    f"({i + 1}, '{n}')" for i, n in enumerate(DRAW_SPECIES)
) + ")"
LOOKUP = "lookup(parameter, process, covariate) as (values " + ", ".join(str(r) for r in V.PARAMETER_LOOKUP) + ")"


def _indexed(table: str, root: str, a: str, b: str) -> str:
    return f"""(select *, cast(regexp_extract(parameter, '\\[(\\d+),', 1) as int) as {a},
      cast(regexp_extract(parameter, ',(\\d+)\\]', 1) as int) as {b} from {table} where parameter like '{root}[%')"""


def _covariates(spark: SparkSession) -> DataFrame:
    return P.named(spark, V.DETECTION_COVARIATES, "covariate", "covariate_no")


def _species(spark: SparkSession) -> DataFrame:
    return P.named(spark, DRAW_SPECIES, "species", "species_no")


_ROUND_STATS = ", ".join(f"round({c}, 6) as {c}" for c in STATS)


@query(S.sql(S.DRAWS, S.SUMMARY, f"select parameter, {_ROUND_STATS} from summary"))
def posterior_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.posterior_summary(S.draws(spark, sf)), *STATS)


RHAT = """chains as (
  select parameter, chain, count(*) as n, avg(value) as m, var_samp(value) as v from draws group by 1, 2),
rhats as (
  select parameter, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) as rhat from chains group by 1)"""


@query(S.sql(S.DRAWS, RHAT, "select parameter, round(rhat, 6) as rhat from rhats"))
def rhat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.rhat(S.draws(spark, sf)), "rhat")


@query(S.sql(S.DRAWS, RHAT, "select parameter, round(rhat, 6) as rhat from rhats where rhat < 1.005"))
def converged(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.converged(posterior.rhat(S.draws(spark, sf)), 1.005), "rhat")


@query(
    S.sql(
        S.DRAWS,
        "bins as (select parameter, cast(floor(value / 0.05::double + 0.5) as bigint) as bin, count(*) as n from draws group by 1, 2)",
        """select parameter, bin, round(bin * 0.05::double, 6) as centre, n,
          round(n / (sum(n) over (partition by parameter) * 0.05::double), 6) as density from bins""",
    )
)
def histogram_density(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.histogram_density(S.draws(spark, sf), ["parameter"], 0.05), "centre", "density")


@query(
    S.sql(
        S.DRAWS,
        "widths as (select parameter, (max(value) - min(value)) / 49 as w from draws group by 1)",
        """bins as (select parameter, w, cast(floor(value / w + 0.5) as bigint) as bin, count(*) as n
          from draws join widths using (parameter) group by 1, 2, 3)""",
        """select parameter, bin, round(bin * w, 6) as centre, n,
          round(n / (sum(n) over (partition by parameter) * w), 6) as density from bins""",
    )
)
def histogram_fifty_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.histogram_bins(S.draws(spark, sf), ["parameter"], 50), "centre", "density")


@query(
    S.sql(
        S.DRAWS,
        """picked as (select parameter, value from draws where parameter like 'betap[%'),
        spread as (select parameter, count(*) as n, stddev_samp(value) as sd, min(value) as lo, max(value) as hi,
          (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34 as iqr from picked group by 1),
        scale as (select *, 0.9 * coalesce(nullif(least(sd, case when iqr > 0 then iqr else sd end), 0), nullif(abs(lo), 0), 1) * pow(n, -0.2) as bw from spread),
        grid as (select *, lo - 3 * bw as x0, (hi - lo + 6 * bw) / 511 as step from scale),
        cells as (select parameter, n, bw, x0, step, floor((value - x0) / step + 0.5) as k, count(*) as c
          from picked join grid using (parameter) group by 1, 2, 3, 4, 5, 6)""",
        """select parameter, cast(g as int) as point, round(x0 + g * step, 6) as x,
          round(sum(c * exp(-0.5 * pow((g - k) * step / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) as density
        from cells, range(512) r(g) group by parameter, g, x0, step""",
    )
)
def kernel_density(spark: SparkSession, sf: str) -> DataFrame:
    picked = S.draws(spark, sf).where(C.root_of("parameter") == "betap").select("parameter", "value")
    return rounded(posterior.kernel_density(picked, ["parameter"]), "x", "density")


@query(
    S.sql(
        S.DRAWS,
        """select chain, parameter, value, row_number() over (partition by chain, parameter order by draw_id) as iteration from draws""",
    )
)
def trace_table(spark: SparkSession, sf: str) -> DataFrame:
    return posterior.trace_table(S.draws(spark, sf))


@query(
    S.sql(
        S.DRAWS,
        """select chain, parameter, value, row_number() over (partition by chain, parameter order by draw_id) as iteration
        from draws where parameter <> 'deviance'""",
    )
)
def trace_without_deviance(spark: SparkSession, sf: str) -> DataFrame:
    return posterior.trace_table(S.draws(spark, sf)).where(F.col("parameter") != "deviance")


@query(
    S.sql(
        S.DRAWS,
        """select chain + 1 as chain, parameter, count(*) as n, round(sum(value), 6) as total from draws group by 1, 2""",
    )
)
def chains_union(spark: SparkSession, sf: str) -> DataFrame:
    """Chains concatenated from separate tables, by name."""
    rows = S.draws(spark, sf)
    parts = [rows.where(F.col("chain") == k).drop("chain") for k in range(3)]
    return rounded(
        posterior.union_chains(parts).groupBy("chain", "parameter").agg(
            F.count("*").alias("n"), F.sum("value").alias("total")
        ),
        "total",
    )


@query(
    S.sql(
        S.DRAWS,
        """select draw_id, parameter, round(value, 6) as value from draws where parameter like '%.site%'
        union all select draw_id, parameter, round(value, 6) from draws where parameter like 'tau%'
        union all select draw_id, parameter, round(value, 6) from draws where parameter = 'alpha.t.p'""",
    )
)
def union_of_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping subsets put under each other keep their repeats."""
    p = F.col("parameter")
    rows = relational.union_of_filters(S.draws(spark, sf), [p.rlike(r"\.site"), p.rlike("^tau"), p == "alpha.t.p"])
    return rounded(rows.select("draw_id", "parameter", "value"), "value")


@query(
    """select vec_id, cast((j - 1) // 8 + 1 as int) as i1, cast((j - 1) % 8 + 1 as int) as i2, round(v, 6) as value
    from (select vec_id, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) as j from embeddings)"""
)
def array_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """An 8 x 8 array per draw, flattened with its true indices."""
    nested = S.table(spark, sf, "embeddings").select(
        "vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8))).alias("a")
    )
    return rounded(posterior.flatten_array(nested, "a", ["vec_id"], depth=2), "value")


@query(
    S.sql(
        S.DRAWS, S.SUMMARY, COVARIATE_NAMES, SPECIES_NAMES,
        f"""use_it as (select covariate_no, species_no, case when mean > 0.5 then 1 end as var_use
          from {_indexed('summary', 'wp', 'covariate_no', 'species_no')})""",
        f"""select covariate_no, species_no, covariate, species, var_use, round(mean * var_use, 6) as mean
        from {_indexed('summary', 'betap', 'covariate_no', 'species_no')} join use_it using (covariate_no, species_no)
          join covariates using (covariate_no) join names using (species_no)""",
    )
)
def important_covariates(spark: SparkSession, sf: str) -> DataFrame:
    means = S.draws(spark, sf).groupBy("parameter").agg(F.avg("value").alias("mean"))
    return rounded(P.important_effects(means, _covariates(spark), _species(spark)), "mean")


@query(
    S.sql(
        S.DRAWS, S.SUMMARY, COVARIATE_NAMES, SPECIES_NAMES,
        f"""use_it as (select covariate_no, species_no
          from {_indexed('summary', 'wp', 'covariate_no', 'species_no')} where mean > 0.5)""",
        f"""select chain, draw_id, covariate, species, round(value, 6) as value
        from {_indexed('draws', 'betap', 'covariate_no', 'species_no')} join use_it using (covariate_no, species_no)
          join covariates using (covariate_no) join names using (species_no)""",
    )
)
def coefficient_draws(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.draws(spark, sf)
    means = rows.groupBy("parameter").agg(F.avg("value").alias("mean"))
    return rounded(P.important_draws(rows, means, _covariates(spark), _species(spark)), "value")


@query(
    S.sql(
        S.DRAWS, LOOKUP,
        """bins as (select covariate, process, cast(floor(value / 0.01::double + 0.5) as bigint) as bin, count(*) as n
          from draws join lookup using (parameter) where parameter <> 'deviance' group by 1, 2, 3)""",
        """select covariate, process, bin, round(bin * 0.01::double, 6) as centre, n,
          round(n / (sum(n) over (partition by covariate, process) * 0.01::double), 6) as density,
          cast(list_position(['Forest (% cover)', 'Agriculture (% cover)', 'Urban (% cover)', 'Temperature', 'Precipitation'], covariate) as bigint) as rank
        from bins""",
    )
)
def process_density(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.process_density(S.draws(spark, sf), P.parameter_lookup(spark))
    ranked = relational.sorted_by_levels(rows, "covariate", V.COVARIATE_ORDER, "process", "bin")
    return rounded(ranked, "centre", "density").withColumn("rank", relational.level_rank("covariate", V.COVARIATE_ORDER))


@query(
    S.sql(
        S.DRAWS, S.SUMMARY, RHAT,
        """both_sides as (select regexp_extract(parameter, '^[a-z.]*', 0) as family,
            cast(regexp_extract(parameter, '(\\d+)$', 1) as int) as no, mean, sd, rhat
          from summary join rhats using (parameter) where parameter like 'mu.%beta%')""",
        """select x.no, round(x.mean, 6) as mean_x, round(x.mean - x.sd, 6) as low_x, round(x.mean + x.sd, 6) as high_x, round(x.rhat, 6) as rhat_x,
          round(y.mean, 6) as mean_y, round(y.mean - y.sd, 6) as low_y, round(y.mean + y.sd, 6) as high_y, round(y.rhat, 6) as rhat_y,
          round(x.rhat * y.rhat, 6) as rhat_prod
        from both_sides x join both_sides y on x.no = y.no where x.family = 'mu.phibeta' and y.family = 'mu.gammabeta'""",
    )
)
def pair_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence against colonisation effects, covariate by covariate."""
    rows = S.draws(spark, sf).where(F.col("parameter").rlike("^mu\\..*beta"))
    moments = rows.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    summary = moments.join(posterior.rhat(rows), "parameter").withColumns(
        {
            "family": F.regexp_extract("parameter", "^[a-z.]*", 0),
            "no": F.regexp_extract("parameter", r"(\d+)$", 1).cast("int"),
        }
    )
    pair = P.compare_pair(summary, "mu.phibeta", "mu.gammabeta", "no")
    return rounded(pair, *[c for c in pair.columns if c != "no"])


@query(
    S.sql(
        S.DRAWS,
        """labelled as (select *, case when regexp_matches(parameter, '\\.site') then 'site'
            when regexp_matches(parameter, 'phi\\.sp') then 'species'
            when regexp_matches(parameter, 'mu\\.d') or regexp_matches(parameter, 'tau\\.lp') or parameter = 'alpha.t.p' then 'detection'
            else 'other' end as family,
          case when regexp_matches(parameter, '\\.site') then replace(replace(replace(replace(replace(parameter,
            '.site', ''), '.0', '.PA_Uncnv'), '.1', '.IM_vs_PA'), '.2', '.Converted'), '.eta', '_eta') else parameter end as name
          from draws)""",
        """select family, string_split(name, '.')[1] as part1, string_split(name, '.')[2] as part2,
          count(*) as n, round(avg(value), 6) as mean from labelled group by 1, 2, 3""",
    )
)
def parameter_families(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.parameter_families(S.draws(spark, sf)).groupBy("family", "part1", "part2")
    return rounded(rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query(
    S.sql(
        S.DRAWS, S.SUMMARY, SPECIES_NAMES,
        f"""select cast(1994 + year_no as int) as year, species, round(mean / 200.0 * 100, 6) as mean,
          round(q2_5 / 200.0 * 100, 6) as min_ci, round(q97_5 / 200.0 * 100, 6) as max_ci
        from {_indexed('summary', 'n.occ', 'year_no', 'species_no')} join names using (species_no)""",
    )
)
def occupancy_trend_percent(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.draws(spark, sf).where(C.root_of("parameter") == "n.occ")
    years = spark.createDataFrame([(i + 1, y) for i, y in enumerate(S.YEARS)], "year_no int, year int")
    out = P.occupied_percent(posterior.posterior_summary(rows), _species(spark), years, F.lit(200.0))
    return rounded(out, "mean", "min_ci", "max_ci")
