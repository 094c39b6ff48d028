"""Scores, trajectories, likelihoods, fits and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark import fixed_values as V
from fieldmark.functions import columns as C
from fieldmark.operators import pruning, replicates
from fieldmark.plans import covariate_fit
from fieldmark.plans import occupancy as O
from fieldmark.plans import occupied_sites
from fieldmark.plans import posterior_tables as P
from fieldmark.plans import scores
from workbook import posteriors as R
from workbook import standins as S
from workbook.registry import query, rounded

N = len(S.YEARS)
INV = "1 / (1 + exp(-({})))"

# -- detection ----------------------------------------------------------------

VISIT_SCORES = f"""years as (
  select year, ln(p / (1 - p)) as palpha from (
    select year, sum(n) / (count(*) * 25.0::double) as p from (
      select year, event_id, count(species) as n from season left join detections using (event_id) group by 1, 2)
    group by 1)),
scored as (
  select event_id, site, year, species,
    {INV.format("palpha + a * (day / 365.0::double) + b * (cast(effort as double) / 500000.0::double)")} as p
  from season join years using (year), coefs)"""


def _visits(spark: SparkSession, sf: str) -> DataFrame:
    return S.season(spark, sf).withColumns(
        {"day_part": F.col("day") / 365.0, "effort_part": F.col("effort").cast("double") / 500000.0}
    )


def _year_intercepts(spark: SparkSession, sf: str) -> DataFrame:
    """Logit of the share of (visit, species) pairs with a record, by year."""
    lists = S.season(spark, sf).select("event_id", "year")
    records = lists.join(S.detections(spark, sf, lists), "event_id").groupBy("year").agg(F.count("*").alias("n"))
    visits = lists.groupBy("year").agg(F.count("*").alias("v"))
    return visits.join(records, "year").select("year", C.logit(F.col("n") / (F.col("v") * 25.0)).alias("palpha"))


def _detection(spark: SparkSession, sf: str) -> DataFrame:
    return scores.detection_score(
        _visits(spark, sf),
        _year_intercepts(spark, sf),
        S.coefficients(spark, sf),
        {"a": "day_part", "b": "effort_part"},
    )


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, S.COEFFICIENTS, VISIT_SCORES,
        "select event_id, site, year, species, round(p, 6) as p from scored",
    )
)
def detection_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_detection(spark, sf), "p")


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, S.COEFFICIENTS, VISIT_SCORES,
        "select species, year, round(avg(p), 6) as mean_p from scored group by 1, 2",
    )
)
def mean_detection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_detection(spark, sf).groupBy("species", "year").agg(F.avg("p").alias("mean_p")), "mean_p")


_SEVEN = {
    "effort_hrs": "cast(effort as double) / 500000.0",
    "day": "day / 365.0",
    "time": "cast(event_id % 24 as double) / 24.0",
    "year": "(year - 1995) / 7.0",
    "pop00_sqmi": "cast(raw_latitude as double) / 50.0",
    "housing_density": "(cast(raw_longitude as double) + 100.0) / 30.0",
    "number_observers": "month / 12.0",
}


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DRAWS, S.SUMMARY, R.COVARIATE_NAMES, R.SPECIES_NAMES, S.COEFFICIENTS,
        f"""weights as (select covariate_no, species_no, case when mean > 0.5 then 1.0 else 0.0 end as weight
          from {R._indexed('summary', 'wp', 'covariate_no', 'species_no')}),
        betas as (select species, covariate, weight * mean as b
          from {R._indexed('summary', 'betap', 'covariate_no', 'species_no')} join weights using (covariate_no, species_no)
            join covariates using (covariate_no) join names using (species_no)),
        long as ("""
        + " union all ".join(
            f"select event_id, '{c}' as covariate, {e.replace('.0', '.0::double')} as x from season" for c, e in _SEVEN.items()
        )
        + ")",
        f"""select event_id, species, round({INV.format('any_value(c.a) + sum(betas.b * x)')}, 6) as p
        from long join betas using (covariate) join coefs c using (species) group by 1, 2""",
    )
)
def weighted_detection_score(spark: SparkSession, sf: str) -> DataFrame:
    """A level per species and seven covariates, switched on by their posterior indicators."""
    means = S.draws(spark, sf).groupBy("parameter").agg(F.avg("value").alias("mean"))
    weights = P.indexed(means, "wp", "covariate_no", "species_no").select(
        "covariate_no", "species_no", F.coalesce(C.important("mean"), F.lit(0)).cast("double").alias("weight")
    )
    betas = (
        P.indexed(means, "betap", "covariate_no", "species_no")
        .join(weights, ["covariate_no", "species_no"])
        .join(R._covariates(spark), "covariate_no")
        .join(R._species(spark), "species_no")
        .select("species", "covariate", "weight", F.col("mean").alias("beta"))
    )
    visits = S.season(spark, sf).select("event_id", *[F.expr(e.replace(".0", ".0D")).alias(c) for c, e in _SEVEN.items()])
    levels = S.coefficients(spark, sf).select("species", F.col("a").alias("alpha"))
    return rounded(scores.weighted_detection_score(visits, betas, V.DETECTION_COVARIATES, intercepts=levels), "p")


# -- persistence and colonisation ---------------------------------------------

LAGGED = """lagged as (
  select p.*, q.temp as temp_prev, q.ppt as ppt_prev from panel p left join panel q on q.site = p.site and q.year = p.year - 1)"""

MAIN = ("forest", "agri", "urban", "ppt", "temp")


def _transition_coefficients(table: DataFrame, names: tuple[str, ...], key: str = "species") -> DataFrame:
    """Spread two numbers per species over the named slopes."""
    slopes = {}
    for prefix, shift in (("phi", 0.5), ("gamma", -0.5)):
        slopes[f"{prefix}_0"] = F.col("a") + shift
        for i, n in enumerate(names):
            slopes[f"{prefix}_{n}"] = (F.col("a") if i % 2 else F.col("b")) * (i + 1) * shift
    return table.select(key, *[c.alias(n) for n, c in slopes.items()])


def _transition_sql(prefix: str, values: tuple[str, ...]) -> str:
    shift = 0.5 if prefix == "phi" else -0.5
    terms = [f"{'a' if i % 2 else 'b'} * {(i + 1) * shift} * {v}" for i, v in enumerate(values)]
    return INV.format(f"a + {shift} + " + " + ".join(terms))


@query(
    S.sql(
        S.CLIMATE, S.COEFFICIENTS, LAGGED,
        f"""select site, year, species, round({_transition_sql('phi', ('forest', 'agri', 'urban', 'ppt_prev', 'temp_prev'))}, 6) as phi,
          round({_transition_sql('gamma', MAIN)}, 6) as gamma from lagged, coefs""",
    )
)
def persistence_colonisation(spark: SparkSession, sf: str) -> DataFrame:
    out = scores.transition_scores(
        S.panel(spark, sf),
        _transition_coefficients(S.coefficients(spark, sf), MAIN),
        ["forest", "agri", "urban"],
        ["ppt", "temp"],
    )
    return rounded(out, "phi", "gamma")


@query(
    S.sql(
        S.CLIMATE, S.COEFFICIENTS, LAGGED,
        f"""select site, year, species, round({_transition_sql('phi', ('forest', 'temp_prev', 'forest * temp_prev'))}, 6) as phi,
          round({_transition_sql('gamma', ('forest', 'temp', 'forest * temp'))}, 6) as gamma from lagged, coefs""",
    )
)
def interaction_score(spark: SparkSession, sf: str) -> DataFrame:
    out = scores.transition_scores(
        S.panel(spark, sf),
        _transition_coefficients(S.coefficients(spark, sf), ("forest", "temp", "forest_temp")),
        ["forest"],
        ["temp"],
        [("forest", "temp")],
    )
    return rounded(out, "phi", "gamma")


TRAITS = """groups as (select mig_status, avg(a) as a, avg(b) as b from coefs join species_info using (species) group by 1),
by_trait as (select species, g.a, g.b, c.a as own from species_info join groups g using (mig_status) join coefs c using (species))"""


def _trait_sql(prefix: str, values: tuple[str, ...]) -> str:
    """As for species, with the intercept from the species' own number."""
    return _transition_sql(prefix, values).replace("-(a + ", "-(own + ")


def _trait_scores(spark: SparkSession, sf: str, constant_gamma: bool) -> DataFrame:
    info, species = S.species_info(spark, sf), _transition_coefficients(S.coefficients(spark, sf), MAIN)
    own = species.select("species", "phi_0", "gamma_0")
    groups = scores.trait_means(S.coefficients(spark, sf), info, ["a", "b"], "mig_status")
    slopes = _transition_coefficients(groups, MAIN, "mig_status").drop("phi_0", "gamma_0")
    table = scores.trait_coefficients(info, slopes, "mig_status", own)
    out = scores.transition_scores(
        S.panel(spark, sf), table, ["forest", "agri", "urban"], ["ppt", "temp"], constant_gamma=constant_gamma
    )
    return rounded(out, "phi", "gamma")


@query(
    S.sql(
        S.CLIMATE, S.COEFFICIENTS, S.SPECIES_INFO, LAGGED,
        TRAITS,
        f"""select site, year, species, round({_trait_sql('phi', ('forest', 'agri', 'urban', 'ppt_prev', 'temp_prev'))}, 6) as phi,
          round({INV.format('own - 0.5')}, 6) as gamma from lagged, by_trait""",
    )
)
def trait_score(spark: SparkSession, sf: str) -> DataFrame:
    """Slopes of persistence by trait group, its intercept and constant colonisation by species."""
    return _trait_scores(spark, sf, constant_gamma=True)


@query(
    S.sql(
        S.CLIMATE, S.COEFFICIENTS, S.SPECIES_INFO, LAGGED,
        TRAITS,
        f"""select site, year, species, round({_trait_sql('phi', ('forest', 'agri', 'urban', 'ppt_prev', 'temp_prev'))}, 6) as phi,
          round({_trait_sql('gamma', MAIN)}, 6) as gamma from lagged, by_trait""",
    )
)
def trait_score_both(spark: SparkSession, sf: str) -> DataFrame:
    """Slopes of both rates by trait group, intercepts by species."""
    return _trait_scores(spark, sf, constant_gamma=False)


# -- trajectories -------------------------------------------------------------

PARAMETERS = f"""parameters as (
  select species, {INV.format('a')} as psi1, {INV.format('1 + b')} as phi, {INV.format('a - 1')} as gamma, {INV.format('b - 1')} as p from coefs)"""


def parameters(spark: SparkSession, sf: str) -> DataFrame:
    return S.coefficients(spark, sf).select(
        "species",
        C.inv_logit(F.col("a")).alias("psi1"),
        C.inv_logit(1 + F.col("b")).alias("phi"),
        C.inv_logit(F.col("a") - 1).alias("gamma"),
        C.inv_logit(F.col("b") - 1).alias("p"),
    )


@query(
    "with recursive "
    + S.sql(
        S.CHECKLISTS, S.COEFFICIENTS, PARAMETERS,
        f"""path as (
          select species, psi1, phi, gamma, 1995 as year, psi1 as psi, cast(null as double) as before from parameters
          union all
          select species, psi1, phi, gamma, year + 1, psi * phi + (1 - psi) * gamma, psi from path where year < {S.YEARS.stop - 1})""",
        """select species, year, round(psi, 6) as psi, round(psi * (select count(distinct site) from checklists), 6) as n_occ,
          round(psi / before, 6) as growth, round((1 - before) * gamma / psi, 6) as turnover from path""",
    )[5:]
)
def psi_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    n_sites = S.checklists(spark, sf).select("site").distinct().agg(F.count("*")).scalar()
    out = O.psi_trajectory(parameters(spark, sf).drop("p"), S.YEARS, n_sites)
    return rounded(out, "psi", "n_occ", "growth", "turnover")


NAIVE = """naive as (
  select s.species, y.year, coalesce(occupied, 0) / surveyed::double as psi
  from (select distinct p_brand as species from part) s
    join (select year, count(distinct site) as surveyed from season group by 1) y on true
    left join (select species, year, count(distinct site) as occupied from season join detections using (event_id) group by 1, 2) d
      on d.species = s.species and d.year = y.year)"""


def _naive(spark: SparkSession, sf: str) -> DataFrame:
    return replicates.naive_occupancy(S.season(spark, sf), S.records(spark, sf), S.species(spark, sf)).select(
        "species", "year", F.col("naive_psi").alias("psi")
    )


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, S.COEFFICIENTS, PARAMETERS, NAIVE,
        """select a.species, a.year, round(a.psi, 6) as psi, round(a.psi / nullif(b.psi, 0), 6) as growth,
          round((1 - b.psi) * gamma / nullif(a.psi, 0), 6) as turnover
        from naive a join parameters using (species) left join naive b on b.species = a.species and b.year = a.year - 1""",
    )
)
def growth_turnover(spark: SparkSession, sf: str) -> DataFrame:
    rows = _naive(spark, sf).join(parameters(spark, sf).select("species", "gamma"), "species")
    return rounded(O.growth_and_turnover(rows).drop("gamma"), "psi", "growth", "turnover")


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS,
        "n as (select count(distinct site) as n_sites from season)",
        """select s.species, y.year, coalesce(n_occ, 0) as n_occ,
          round(coalesce(n_occ, 0) * 100.0::double / (select n_sites from n), 6) as percent
        from (select distinct p_brand as species from part) s join (select distinct year from season) y on true
          left join (select species, year, count(distinct site) as n_occ from season join detections using (event_id) group by 1, 2) d
            on d.species = s.species and d.year = y.year""",
    )
)
def occupied_share(spark: SparkSession, sf: str) -> DataFrame:
    """Occupied sites from 0/1 states, as a share of all sites."""
    lists = S.season(spark, sf)
    n_sites = lists.select("site").distinct().agg(F.count("*")).scalar()
    states = replicates.naive_state(lists, S.records(spark, sf), S.species(spark, sf))
    return rounded(O.occupied_share(states, n_sites, "z0"), "percent")


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, NAIVE,
        """fit as (select species, count(psi) as n, regr_slope(psi, year) as slope, regr_sxx(psi, year) as sxx, regr_syy(psi, year) as syy
          from naive group by 1),
        ratio as (select *, slope / sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2) / sxx) as t_ratio from fit)""",
        """select species, n, round(slope, 6) as slope, round(t_ratio, 6) as t_ratio,
          case when t_ratio > 2 then 'increasing' when t_ratio < -2 then 'declining' else 'stable' end as trend from ratio""",
    )
)
def species_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(O.species_trend(_naive(spark, sf)), "slope", "t_ratio")


# -- likelihood and fits ------------------------------------------------------


def _pivot(value: str) -> str:
    return ", ".join(f"coalesce(max(case when year = {y} then {value} end), 0) as {value}{i}" for i, y in enumerate(S.YEARS))


HISTORIES = f"""effort as (select site, {_pivot('t')} from (
    select site, year, count(distinct obs_date) as t from season group by 1, 2) group by 1),
hits as (select site, species, {_pivot('k')} from (
    select site, species, year, count(distinct obs_date) as k from season join detections using (event_id) group by 1, 2, 3) group by 1, 2),
hist as (select e.*, s.species, {', '.join(f'coalesce(k{i}, 0) as k{i}' for i in range(N))}
  from effort e join (select distinct p_brand as species from part) s on true
    left join hits h on h.site = e.site and h.species = s.species)"""


def _chain(name: str, source: str, by_year: bool = False, evidence: bool = False) -> str:
    """The two-state chain written out year by year, each year a table of its own; the last is ``name``."""
    tables, current = [], source
    y = (lambda i: str(i)) if by_year else (lambda i: "")

    def add(label: str, steps: list[str]) -> None:
        nonlocal current
        body = current
        for step in steps:
            body = f"(select *, {step} from {body})"
        tables.append(f"{label} as materialized (select * from {body})")
        current = label

    for i in range(N):
        start = ["psi1 as pr0"] if i == 0 else []
        add(
            f"{name}_f{i}",
            start
            + [
                f"exp(lh{i}) as hit{i}" if evidence else f"exp(k{i} * ln(p{y(i)}) + (t{i} - k{i}) * ln(1 - p{y(i)})) as hit{i}",
                f"pr{i} * hit{i} + case when k{i} > 0 then 0 else 1 - pr{i} end as like{i}",
                f"pr{i} * hit{i} / like{i} as f{i}",
                *([] if i == N - 1 else [f"f{i} * phi{y(i)} + (1 - f{i}) * gamma{y(i)} as pr{i + 1}"]),
            ],
        )
    loglik = " + ".join(f"ln(like{i})" for i in range(N)) + " as loglik"
    add(f"{name}_l", [f"f{N - 1} as s{N - 1}", loglik])
    for i in reversed(range(N - 1)):
        add(
            name if i == 0 else f"{name}_b{i}",
            [
                f"f{i} * phi{y(i)} * s{i + 1} / pr{i + 1} as x{i}",
                f"(1 - f{i}) * gamma{y(i)} * s{i + 1} / pr{i + 1} as c{i}",
                f"x{i} + f{i} * (1 - phi{y(i)}) * (1 - s{i + 1}) / (1 - pr{i + 1}) as s{i}",
            ],
        )
    return ",\n".join(tables)


def _sum(prefix: str, n: int, factor: str = "") -> str:
    return " + ".join(f"{prefix}{i}{factor.format(i)}" for i in range(n))


def histories(spark: SparkSession, sf: str) -> DataFrame:
    lists = S.season(spark, sf)
    return O.site_histories(lists, S.records(spark, sf, lists), S.species(spark, sf), S.YEARS)


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, S.COEFFICIENTS, PARAMETERS, HISTORIES,
        _chain("smooth", "(select * from hist join parameters using (species))"),
        f"select site, species, round(loglik, 6) as loglik, round(s{N - 1}, 6) as filtered from smooth",
    )
)
def history_loglik(spark: SparkSession, sf: str) -> DataFrame:
    params = O.constant_parameters(parameters(spark, sf), N)
    return rounded(O.history_loglik(histories(spark, sf), params, N), "loglik", "filtered")


def _by_year(value: str, name: str, first: int, n: int, missing: str | None = None) -> str:
    cases = [f"max(case when year = {S.YEARS.start + first + i} then {value} end)" for i in range(n)]
    return ", ".join((f"coalesce({c}, {missing})" if missing else c) + f" as {name}{i}" for i, c in enumerate(cases))


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, S.COEFFICIENTS, PARAMETERS, VISIT_SCORES, S.CLIMATE, LAGGED,
        """seen_or_not as (select c.*, case when d.species is null then 0 else 1 end as y from scored c
          left join (select distinct event_id, species from detections) d on d.event_id = c.event_id and d.species = c.species)""",
        """yearly as (select site, species, year, max(y) as k, sum(case when y = 1 then ln(p) else ln(1 - p) end) as lh
          from seen_or_not group by 1, 2, 3)""",
        f"packed as (select site, species, {_by_year('k', 'k', 0, N, '0')}, {_by_year('lh', 'lh', 0, N, '0')} from yearly group by 1, 2)",
        f"""moves as (select site, year, species, {_transition_sql('phi', ('forest', 'agri', 'urban', 'ppt_prev', 'temp_prev'))} as phi,
          {_transition_sql('gamma', MAIN)} as gamma from lagged, coefs)""",
        f"""steps as (select site, species, {_by_year('phi', 'phi', 1, N - 1)}, {_by_year('gamma', 'gamma', 1, N - 1)} from moves
          where year between {S.YEARS.start + 1} and {S.YEARS.stop - 1} group by 1, 2 having count(phi) = {N - 1} and count(gamma) = {N - 1})""",
        _chain(
            "covs",
            "(select * from packed join steps using (site, species) join (select species, psi1 from parameters) using (species))",
            by_year=True,
            evidence=True,
        ),
        f"select site, species, round(loglik, 6) as loglik, round(s{N - 1}, 6) as filtered from covs",
    )
)
def covariate_loglik(spark: SparkSession, sf: str) -> DataFrame:
    """Likelihood with a detection probability of every visit and rates of every site and year.

    Sites without covariates in some year are left out, as in a table of complete cases.
    """
    lists = S.season(spark, sf).select("event_id")
    found = S.detections(spark, sf, lists).select("event_id", "species").distinct().withColumn("y", F.lit(1))
    scored = _detection(spark, sf).join(found, ["event_id", "species"], "left").fillna(0, ["y"])
    packed = O.pack_emissions(O.visit_emissions(scored), S.YEARS)
    moves = scores.transition_scores(
        S.panel(spark, sf), _transition_coefficients(S.coefficients(spark, sf), MAIN), ["forest", "agri", "urban"], ["ppt", "temp"]
    ).where(F.col("year").between(S.YEARS.start + 1, S.YEARS.stop - 1) & F.col("phi").isNotNull() & F.col("gamma").isNotNull())
    steps = (
        moves.groupBy("site", "species")
        .agg(F.array_sort(F.collect_list(F.struct("year", "phi", "gamma"))).alias("s"))  # one entry per year
        .where(F.size("s") == N - 1)
        .select("site", "species", F.col("s.phi").alias("phi"), F.col("s.gamma").alias("gamma"))
    )
    rows = packed.join(steps, ["site", "species"]).join(parameters(spark, sf).select("species", "psi1"), "species")
    return rounded(O.loglik_of(rows, N), "loglik", "filtered")


@query(
    "with recursive "
    + S.sql(
        S.COEFFICIENTS, PARAMETERS,
        f"""path as (
          select species, draw, gamma, phi, {S.YEARS.start} as year, psi1 * (1 - draw / 10.0::double) as psi, cast(null as double) as before
          from parameters, range(5) d(draw)
          union all
          select species, draw, gamma, phi, year + 1, psi * phi + (1 - psi) * gamma, psi from path where year < {S.YEARS.stop - 1})""",
        """select species, draw::int as draw, year, round(psi, 6) as psi, round(psi / before, 6) as growth,
          round((1 - before) * gamma / psi, 6) as turnover from path""",
    )[5:]
)
def psi_trajectory_draws(spark: SparkSession, sf: str) -> DataFrame:
    """The recursion for every draw of the parameters."""
    rows = parameters(spark, sf).drop("p").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(4))))
    rows = rows.withColumn("psi1", F.col("psi1") * (1 - F.col("draw") / 10.0))
    return rounded(O.psi_trajectory(rows, S.YEARS), "psi", "growth", "turnover")


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, S.COEFFICIENTS, PARAMETERS, HISTORIES,
        _chain("smooth", "(select * from hist join parameters using (species))"),
        " union all ".join(
            f"select site, species, {y} as year, round(s{i}, 6) as z_prob from smooth" for i, y in enumerate(S.YEARS)
        ),
    )
)
def smoothed_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    params = O.constant_parameters(parameters(spark, sf), N)
    return rounded(O.smoothed_occupancy(histories(spark, sf), params, S.YEARS), "z_prob")


@query(
    "with recursive "
    + S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, S.COEFFICIENTS, PARAMETERS, HISTORIES,
        _chain("smooth", "(select * from hist join parameters using (species))"),
        "chances as materialized (select species, year, z, row_number() over (partition by species, year order by site) as i from ("
        + " union all ".join(f"select site, species, {y} as year, s{i} as z from smooth" for i, y in enumerate(S.YEARS))
        + "))",
        """sums(species, year, i, masses) as (
          select distinct species, year, 0::bigint, [1.0::double] from chances
          union all
          select s.species, s.year, s.i + 1, list_transform(range(len(masses) + 1),
            lambda k: coalesce(masses[k + 1], 0) * (1 - z) + case when k > 0 then masses[k] * z else 0 end)
          from sums s join chances c on c.species = s.species and c.year = s.year and c.i = s.i + 1)""",
        "last as (select * from sums qualify row_number() over (partition by species, year order by i desc) = 1)",
        "mass as (select species, year, i as n_sites, unnest(masses) as m, unnest(range(len(masses))) as k from last)",
        "upto as (select *, sum(m) over (partition by species, year order by k) as c from mass)",
        "stats as (select species, year, n_sites, sum(m * k) as mean, sum(m * k * k) as square, min(k) filter (where c >= 0.025 - 1e-12) as lower, min(k) filter (where c >= 0.975 - 1e-12) as upper from upto group by 1, 2, 3)",
        """select species, year, n_sites, round(mean, 6) as mean, lower, upper, round(mean * 100 / n_sites, 6) as mean_percent,
          round(lower * 100.0::double / n_sites, 6) as lower_percent, round(upper * 100.0::double / n_sites, 6) as upper_percent from stats""",
    )[5:]
)
def occupied_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Occupied sites by species and year with 95 % bounds, from the smoothed occupancy of every site."""
    params = O.constant_parameters(parameters(spark, sf), N)
    chances = O.smoothed_occupancy(histories(spark, sf), params, S.YEARS)
    bounds = occupied_sites.occupied_bounds(occupied_sites.occupied_distribution(chances))
    return rounded(bounds.drop("sd"), "mean", "mean_percent", "lower_percent", "upper_percent")


ITERATIONS = 4
_CLAMP = "greatest(1e-6, least(1 - 1e-6, {}))"


def _em_step(i: int) -> str:
    """One iteration in SQL: table em{i} from em{i - 1}."""
    source = f"(select * from em{i - 1} join hist using (species))"
    return f"""{_chain(f"chain{i}", source)},
  em{i} as materialized (select species, {_CLAMP.format('sum(s0) / count(*)')} as psi1,
    {_CLAMP.format(f"sum({_sum('x', N - 1)}) / sum({_sum('s', N - 1)})")} as phi,
    {_CLAMP.format(f"sum({_sum('c', N - 1)}) / sum({_sum('1 - s', N - 1)})")} as gamma,
    {_CLAMP.format(f"sum({_sum('s', N, ' * k{}')}) / sum({_sum('s', N, ' * t{}')})")} as p, sum(loglik) as total
  from chain{i} group by species)"""


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, HISTORIES,
        """em0 as (select distinct p_brand as species, 0.5::double as psi1, 0.8::double as phi, 0.2::double as gamma,
          0.3::double as p from part)""",
        *[_em_step(i) for i in range(1, ITERATIONS + 2)],
        f"""select e.species, round(e.psi1, 6) as psi1, round(e.phi, 6) as phi, round(e.gamma, 6) as gamma, round(e.p, 6) as p,
          round(f.total, 6) as loglik, {ITERATIONS} as iterations, abs(f.total - e.total) <= 0 as converged
        from em{ITERATIONS} e join em{ITERATIONS + 1} f using (species)""",
    )
)
def fit_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    """A stated number of EM iterations, so that the oracle can repeat them; the rows say that they did not end."""
    fit = O.fit_dynamic(histories(spark, sf), N, iterations=ITERATIONS, tolerance=0)
    first = fit.select("species", "psi1", *[F.col(c)[0].alias(c) for c in ("phi", "gamma", "p")], "loglik", "iterations", "converged")
    return rounded(first, "psi1", "phi", "gamma", "p", "loglik")


YEARLY_ITERATIONS = 2


def _em_year_step(i: int) -> str:
    """One iteration with parameters of every year; a rate without a denominator is a half."""
    source = f"(select * from ey{i - 1} join hist using (species))"
    rate = lambda a, b: _CLAMP.format(f"coalesce(sum({a}) / nullif(sum({b}), 0), 0.5)")
    steps = [f"{rate(f'x{t}', f's{t}')} as phi{t}, {rate(f'c{t}', f'1 - s{t}')} as gamma{t}" for t in range(N - 1)]
    seen = [f"{rate(f's{t} * k{t}', f's{t} * t{t}')} as p{t}" for t in range(N)]
    return f"""{_chain(f"cy{i}", source, by_year=True)},
  ey{i} as materialized (select species, {_CLAMP.format('sum(s0) / count(*)')} as psi1, {', '.join(steps + seen)}, sum(loglik) as total
  from cy{i} group by species)"""


_START_BY_YEAR = ", ".join(
    [f"0.8::double as phi{t}, 0.2::double as gamma{t}" for t in range(N - 1)] + [f"0.3::double as p{t}" for t in range(N)]
)


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, HISTORIES,
        f"ey0 as (select distinct p_brand as species, 0.5::double as psi1, {_START_BY_YEAR} from part)",
        *[_em_year_step(i) for i in range(1, YEARLY_ITERATIONS + 2)],
        " union all ".join(
            f"""select e.species, {year} as year, round(e.psi1, 6) as psi1,
              {f'round(e.phi{t}, 6)' if t < N - 1 else 'null::double'} as phi,
              {f'round(e.gamma{t}, 6)' if t < N - 1 else 'null::double'} as gamma,
              round(e.p{t}, 6) as p, round(f.total, 6) as loglik, false as converged
            from ey{YEARLY_ITERATIONS} e join ey{YEARLY_ITERATIONS + 1} f using (species)"""
            for t, year in enumerate(S.YEARS)
        ),
    )
)
def fit_dynamic_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence, colonisation and detection of every year; the last year has no step after it."""
    fit = O.fit_dynamic(histories(spark, sf), N, iterations=YEARLY_ITERATIONS, tolerance=0, by_year=True)
    rows = fit.select("species", "psi1", "phi", "gamma", F.posexplode("p").alias("i", "prob"), "loglik", "converged")
    step = lambda c: F.when(F.col("i") < N - 1, F.get(c, F.col("i")))
    out = rows.select(
        "species", (F.col("i") + S.YEARS.start).alias("year"), "psi1", step("phi").alias("phi"), step("gamma").alias("gamma"),
        F.col("prob").alias("p"), "loglik", "converged",
    )
    return rounded(out, "psi1", "phi", "gamma", "p", "loglik")


SINGLE_ITERATIONS, SINGLE_TOLERANCE = 100, 1e-5


@query(
    "with recursive "
    + S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS,
        """effort as (select site, year, count(distinct obs_date) as t from season group by 1, 2),
        hits as (select site, year, species, count(distinct obs_date) as k from season join detections using (event_id) group by 1, 2, 3),
        counts as (select s.species, coalesce(k, 0) as k, t, count(*) as w
          from effort e join (select distinct p_brand as species from part) s on true
            left join hits h on h.site = e.site and h.year = e.year and h.species = s.species group by 1, 2, 3)""",
        f"""em as (
          select 0 as it, species, 0.5::double as psi, 0.5::double as p, false as ended from (select distinct p_brand as species from part)
          union all
          select it + 1, species, psi1, p1, greatest(abs(psi1 - psi), abs(p1 - p)) <= {SINGLE_TOLERANCE} from (
            select it, species, psi, p, {_CLAMP.format('sum(w * e) / sum(w)')} as psi1, {_CLAMP.format('sum(w * e * k) / sum(w * e * t)')} as p1
            from (select *, case when k > 0 then 1.0::double else psi * exp(t * ln(1 - p)) / (psi * exp(t * ln(1 - p)) + 1 - psi) end as e
              from em join counts using (species) where it < {SINGLE_ITERATIONS} and not ended)
            group by it, species, psi, p))""",
        f"""select species, round(psi, 6) as psi, round(p, 6) as p,
          round(sum(w * case when k > 0 then 1.0::double else psi * exp(t * ln(1 - p)) / (psi * exp(t * ln(1 - p)) + 1 - psi) end), 6) as n_occ,
          ended as converged
        from (select * from em qualify row_number() over (partition by species order by it desc) = 1) join counts using (species)
        group by 1, 2, 3, 5""",
    )[5:]
)
def fit_single_season(spark: SparkSession, sf: str) -> DataFrame:
    """Each site-year as one closed season of its own."""
    lists = S.season(spark, sf).withColumn("site", F.col("site") * 10000 + F.col("year"))
    counts = O.season_counts(lists, S.records(spark, sf), S.species(spark, sf))
    return rounded(O.fit_single_season(counts, SINGLE_ITERATIONS, tolerance=SINGLE_TOLERANCE), "psi", "p", "n_occ")


# -- the covariate model ------------------------------------------------------

COVARIATES = ("forest", "agri", "urban", "ppt", "temp")
VISIT = ("day_part", "effort_part")
PRECISION = 0.01


def _solve(name: str, source: str, n: int) -> str:
    """Gauss-Jordan elimination of a{r}_{c} x = b{r} per species, a table for each pivot; ``name`` has x0, x1, ..."""
    tables, current = [], source
    for i in range(n):
        rows = []
        for r in range(n):
            drop = "" if r == i else f" - a{r}_{i} / a{i}_{i} * "
            rows += [f"a{r}_{c}{drop and drop + f'a{i}_{c}'} as a{r}_{c}" for c in range(n)]
            rows.append(f"b{r}{drop and drop + f'b{i}'} as b{r}")
        tables.append(f"{name}_{i} as materialized (select species, {', '.join(rows)} from {current})")
        current = f"{name}_{i}"
    tables.append(f"{name} as materialized (select species, {', '.join(f'b{r} / a{r}_{r} as x{r}' for r in range(n))} from {current})")
    return ",\n".join(tables)


def _system(rows: str, columns: tuple[str, ...], start: tuple[float, ...]) -> str:
    """Normal equations of a Newton step from ``rows`` (species, w, mu, resp and covariates) under the wide prior."""
    n = len(columns)
    weight = "w * mu * (1 - mu)"
    cells = [f"sum({weight} * {columns[r]} * {columns[c]}) + {PRECISION + 1e-12 if r == c else 0.0!r} as a{r}_{c}" for r in range(n) for c in range(n)]
    cells += [f"sum((resp - w * mu) * {columns[r]}) - {PRECISION * start[r]!r}::double as b{r}" for r in range(n)]
    return f"(select species, {', '.join(cells)} from ({rows}) group by species)"


_RATE_START = {"phi": (1.5,) + (0.0,) * len(COVARIATES), "gamma": (-1.5,) + (0.0,) * len(COVARIATES)}


def _linear_sql(prefix: str, columns: tuple[str, ...]) -> str:
    return " + ".join([f"{prefix}0", *(f"{prefix}{i + 1} * {c}" for i, c in enumerate(columns))])


def _covariate_chain(i: int) -> str:
    """Scores of visits and site-years and the smoothed chain under the thetas of table th{i}."""
    return f"""cs{i} as (select v.*, species, {INV.format("palpha + " + _linear_sql("ed", VISIT))} as prob from cvisits v, th{i}),
  cy{i} as (select site, species, year, max(y) as k, sum(n_seen * ln(prob) + (1 - n_seen) * ln(1 - prob)) as lh from (
    select c.*, coalesce(d.y, 0) as y, coalesce(d.y, 0) as n_seen from cs{i} c left join (select distinct event_id, species, 1 as y from detections) d using (event_id, species)) group by 1, 2, 3),
  cp{i} as (select site, species, {_by_year('k', 'k', 0, N, '0')}, {_by_year('lh', 'lh', 0, N, '0')} from cy{i} group by 1, 2),
  cm{i} as (select site, year, species, {INV.format(_linear_sql("ef", COVARIATES))} as phi, {INV.format(_linear_sql("eg", COVARIATES))} as gamma from ccells, th{i}),
  cr{i} as (select site, species, {_by_year('phi', 'phi', 0, N - 1)}, {_by_year('gamma', 'gamma', 1, N - 1)} from cm{i} group by 1, 2),
  {_chain(f"cv{i}", f"(select * from cp{i} join cr{i} using (site, species) join (select species, 1 / (1 + exp(-psi)) as psi1 from th{i}) using (species))", by_year=True, evidence=True)}"""


def _rate_rows(weight: str, response: str, rate: str, shift: int) -> str:
    return " union all ".join(
        f"select species, {weight.format(t)} as w, {response}{t} as resp, {rate}{t} as mu, 1.0::double as one, {', '.join(COVARIATES)} from cv0 join ccells using (site) where year = {S.YEARS.start + t + shift}"
        for t in range(N - 1)
    )


_DETECTION_ROWS = (
    "select c.species, z.s as w, coalesce(d.y, 0) * z.s as resp, prob as mu, 1.0::double as one, day_part, effort_part from cs0 c join ("
    + " union all ".join(f"select site, species, {y} as year, s{t} as s from cv0" for t, y in enumerate(S.YEARS))
    + ") z using (site, species, year) left join (select distinct event_id, species, 1 as y from detections) d using (event_id, species)"
)


def _theta_columns() -> list[str]:
    return ["psi", *(f"e{p}{i}" for p in "fg" for i in range(1 + len(COVARIATES))), *(f"ed{i}" for i in range(1 + len(VISIT)))]


_START = {"ef0": 1.5, "eg0": -1.5}


def _survey(spark: SparkSession, sf: str):
    lists = _visits(spark, sf).join(_year_intercepts(spark, sf), "year")
    return covariate_fit.pack(lists, S.records(spark, sf), S.species(spark, sf), S.panel(spark, sf), S.YEARS, ["forest", "agri", "urban"], ["ppt", "temp"], VISIT, offset="palpha")


def _named(names: tuple[str, ...], source: str) -> str:
    return " union all ".join(f"select species, '{label}' as parameter, {column} as estimate from {source}" for label, column in zip(names, _theta_columns()))


_LABELS = ("psi1", *(f"{p}_{c}" for p in ("phi", "gamma") for c in ("0", *COVARIATES)), *(f"p_{c}" for c in ("0", *VISIT)))


@query(
    S.sql(
        S.CHECKLISTS, S.SEASON, S.DETECTIONS, S.CLIMATE,
        """years as (select year, ln(p / (1 - p)) as palpha from (select year, sum(n) / (count(*) * 25.0::double) as p from (
          select year, event_id, count(species) as n from season left join detections using (event_id) group by 1, 2) group by 1))""",
        f"""ccells as materialized (select * from (select site, year, {', '.join(COVARIATES)}, count(*) over (partition by site) as n from panel
          where year between {S.YEARS.start} and {S.YEARS.stop - 1}) where n = {N})""",
        f"""cvisits as materialized (select event_id, site, year, palpha, day / 365.0::double as day_part, cast(effort as double) / 500000.0::double as effort_part
          from season join years using (year) where site in (select site from ccells) and year between {S.YEARS.start} and {S.YEARS.stop - 1})""",
        f"th0 as (select distinct p_brand as species, {', '.join(f'{_START.get(c, 0.0)!r}::double as {c}' for c in _theta_columns())} from part)",
        _covariate_chain(0),
        "first as (select species, avg(s0) as m from cv0 group by 1)",
        _solve("np", _system(_rate_rows("s{}", "x", "phi", 0), ("one", *COVARIATES), _RATE_START["phi"]), 1 + len(COVARIATES)),
        _solve("ng", _system(_rate_rows("(1 - s{})", "c", "gamma", 1), ("one", *COVARIATES), _RATE_START["gamma"]), 1 + len(COVARIATES)),
        _solve("nd", _system(_DETECTION_ROWS, ("one", *VISIT), (0.0,) * (1 + len(VISIT))), 1 + len(VISIT)),
        f"""th1 as materialized (select species, ln(m / (1 - m)) as psi, {', '.join(f'{_START.get(f"ef{i}", 0.0)!r}::double + np.x{i} as ef{i}' for i in range(1 + len(COVARIATES)))},
          {', '.join(f'{_START.get(f"eg{i}", 0.0)!r}::double + ng.x{i} as eg{i}' for i in range(1 + len(COVARIATES)))}, {', '.join(f'nd.x{i} as ed{i}' for i in range(1 + len(VISIT)))}
          from first join np using (species) join ng using (species) join nd using (species))""",
        _covariate_chain(1),
        f"""fitted as (select species, sum(loglik) - {PRECISION / 2!r} * any_value({' + '.join(f'{c} * {c}' for c in _theta_columns()[1:])}) as objective from cv1 join th1 using (species) group by 1)""",
        f"""select species, parameter, round(estimate, 6) as estimate, round(objective, 6) as objective from ({_named(_LABELS, 'th1')}) join fitted using (species)""",
    )
)
def fit_covariates(spark: SparkSession, sf: str) -> DataFrame:
    """One EM step of the covariate model from fixed starts, and the log-posterior there, so that the oracle can repeat it."""
    survey = _survey(spark, sf)
    fit = covariate_fit.fit(survey, iterations=2, leaps=False, errors=False)
    long = covariate_fit.coefficients(survey, fit).join(fit.select("species", "objective"), "species")
    return rounded(long, "estimate", "objective")


@query()
def fit_dynamic_converged(spark: SparkSession, sf: str) -> DataFrame:
    """Constant rates fitted to their end by accelerated EM, with standard errors of the logits."""
    fit = O.fit_dynamic_with_errors(histories(spark, sf), N)
    errors = [F.get("errors", F.lit(i)).alias(f"se_{c}") for i, c in enumerate(("psi1", "phi", "gamma", "p"))]
    out = fit.select("species", "psi1", "phi", "gamma", "p", *errors, "loglik", "iterations", "converged")
    return rounded(out, "psi1", "phi", "gamma", "p", "se_psi1", "se_phi", "se_gamma", "se_p", "loglik", places=3)
