"""Fit of the dynamic occupancy model with covariates, many species at once.

Persistence and colonisation depend on site and site-year covariates, detection
on those of the visit, each by its own logistic regression; the first year's
occupancy is one number per species.  One EM step is one job: tasks hold sites
with all their years and visits, walk the two-state chain for a share of the
species, and send one row of sums per species: its log-likelihood and the gradient and
Gram matrix of each regression.  The maximisation is a Newton step (iteratively reweighted
least squares) on those sums.  The survey never leaves its sites, and only
species-size tables are settled between steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.plans import fitting
from fieldmark.session import checked_broadcast, settle, spread

#: Species that a task works on together, and numbers (site x year x species) it holds at once.
SHARE, AT_ONCE = 64, 400_000
#: Numbers (8 bytes each) that a table of thetas may hold to be broadcast.
BROADCAST_NUMBERS = 4_000_000
EDGE = 1e-9


@dataclass(frozen=True)
class Design:
    """Sizes of the three regressions, intercepts included, and the number of years."""

    years: int
    rates: int
    detection: int
    offset: bool = False

    @property
    def size(self) -> int:
        return 1 + 2 * self.rates + self.detection

    @property
    def parts(self) -> tuple[slice, slice, slice]:
        """Places of persistence, colonisation and detection in theta; the logit of the first year's occupancy comes first."""
        r = self.rates
        return slice(1, 1 + r), slice(1 + r, 1 + 2 * r), slice(1 + 2 * r, self.size)

    @property
    def sums(self) -> int:
        triangle = lambda k: k * (k + 1) // 2
        return 3 + 2 * (self.rates + triangle(self.rates)) + self.detection + triangle(self.detection)


@dataclass(frozen=True)
class Survey:
    """Packed sites, the species with their codes, and the design."""

    sites: DataFrame
    codes: DataFrame
    n_species: int
    design: Design
    names: tuple[str, ...]

    def hinted(self, table: DataFrame, rows_each: int = 1) -> DataFrame:
        """A table with ``rows_each`` thetas per species, broadcast if their number, which is known, makes that small."""
        return F.broadcast(table) if self.n_species * rows_each * self.design.size <= BROADCAST_NUMBERS else table


def pack(
    checklists: DataFrame, detections: DataFrame, species: DataFrame, panel: DataFrame, years: range,
    static: Sequence[str], yearly: Sequence[str], visit: Sequence[str], offset: str | None = None, site: str = "site", event: str = "event_id",
) -> Survey:
    """One row per site: its covariates by year, its visits by year, and who was seen.

    ``panel`` has ``static`` and ``yearly`` covariates per site and year, ``checklists``
    the ``visit`` covariates and a known ``offset`` of the detection logit.
    Sites that lack a covariate in a year of ``years`` and visits that lack one are left out (complete
    cases), as are visits outside the years.  Visits of a site and year with equal covariates are
    merged into one with counts, which changes nothing.
    """
    first, n_years = years.start, len(years)
    terms = [*visit, *([offset] if offset else [])]
    index = (F.col("year") - F.lit(first)).cast("int")
    names = species.select("species").where("species is not null").distinct()
    codes = settle(names.agg(F.array_sort(F.collect_list("species")).alias("s")).select(F.posexplode("s").alias("code", "species")))
    events = (
        checklists.where(F.col("year").between(first, years.stop - 1)).select(event, site, index.alias("t"), *[F.col(c).cast("double").alias(c) for c in terms]).dropna()
    )
    group = [site, "t", *terms]
    seen = detections.select(event, "species").join(events, event).join(checked_broadcast(codes, settled=True), "species")
    seen = seen.select(event, "code", *group).distinct()
    hits = seen.groupBy(*group, "code").agg(F.count("*").alias("k")).groupBy(*group).agg(F.collect_list(F.struct("code", F.col("k").cast("int").alias("k"))).alias("hits"))
    counts = events.groupBy(*group).agg(F.count("*").cast("double").alias("n"))
    visits = spread(counts.join(hits, group, "left"), site).groupBy(site).agg(F.sort_array(F.collect_list(F.struct("t", "n", *terms, "hits"))).alias("v"))
    covariates = [*static, *yearly]
    cells = panel.where(F.col("year").between(first, years.stop - 1)).select(site, index.alias("t"), *[F.col(c).cast("double").alias(c) for c in covariates]).dropna()
    x = cells.groupBy(site).agg(F.sort_array(F.collect_list(F.struct("t", *covariates))).alias("x")).where(F.size("x") == n_years)
    double = lambda c: c.cast("double")
    none = F.array().cast("array<array<int>>")
    packed = visits.join(x, site).select(
        F.col(site).alias("site"),
        F.flatten(F.transform("x", lambda r: F.array(F.lit(1.0), *[r[c] for c in covariates]))).alias("x"),
        F.flatten(F.transform("v", lambda r: F.array(double(r["t"]), r["n"], *[r[c] for c in terms]))).alias("v"),
        F.flatten(F.transform("v", lambda r, i: F.coalesce(F.transform(r["hits"], lambda h: F.array(i, h["code"], h["k"])), none))).alias("hits"),
    )
    n_species = codes.count()
    shares = -(-n_species // SHARE)
    dealt = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(max(shares, 1) - 1))))
    own = F.filter("hits", lambda h: F.floor(h[1] / SHARE) == F.col("share"))
    sites = settle(dealt.select("site", "share", "x", "v", F.flatten(own).alias("hits")))
    design = Design(n_years, 1 + len(covariates), 1 + len(visit), offset is not None)
    labels = ("psi1", *(f"{p}_{c}" for p in ("phi", "gamma") for c in ("0", *covariates)), *(f"p_{c}" for c in ("0", *visit)))
    return Survey(sites, codes, n_species, design, labels)



def _expit(eta: np.ndarray) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-eta)), EDGE, 1 - EDGE)


def _gram(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Upper triangles of sum of weight x x', one row per species; ``weight`` is (rows, species)."""
    i, j = np.triu_indices(x.shape[1])
    return weight.T @ (x[:, i] * x[:, j])


def chain_sums(design: Design, x: np.ndarray, cell: np.ndarray, v: np.ndarray, k: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Sums of an EM step over some sites, one row per column of ``theta``'s species.

    ``x`` is (sites, years, rates); ``v`` the visits' count and covariates, ``cell`` their site x years + year, in
    order; ``k`` (visits, species) how often a species was seen; ``theta`` (species, size).
    """
    n_sites, n_years, _ = x.shape
    phi_at, gamma_at, p_at = design.parts
    before, now = x[:, :-1], x[:, 1:]
    phi, gamma = _expit(before @ theta[:, phi_at].T), _expit(now @ theta[:, gamma_at].T)
    psi1 = _expit(theta[:, 0])
    z = np.column_stack((np.ones(len(v)), v[:, 1 : design.detection]))
    eta = z @ theta[:, p_at].T + (v[:, -1:] if design.offset else 0.0)
    n = v[:, :1]
    log_p, log_q = -np.logaddexp(0, -eta), -np.logaddexp(0, eta)
    record = np.zeros((n_sites * n_years, len(theta)))
    seen = np.zeros(record.shape, bool)
    if len(v):
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        record[cell[starts]] = np.add.reduceat(k * log_p + (n - k) * log_q, starts)
        seen[cell[starts]] = np.add.reduceat(k, starts) > 0
    record, seen = record.reshape(n_sites, n_years, -1), seen.reshape(n_sites, n_years, -1)
    pred = np.empty_like(record)
    filt = np.empty_like(record)
    ll = np.zeros((n_sites, len(theta)))
    pred[:, 0] = psi1
    for t in range(n_years):
        hit = np.exp(record[:, t])
        quiet = pred[:, t] * hit + 1 - pred[:, t]
        filt[:, t] = np.where(seen[:, t], 1.0, pred[:, t] * hit / quiet)
        ll += np.where(seen[:, t], np.log(pred[:, t]) + record[:, t], np.log(quiet))
        if t + 1 < n_years:
            pred[:, t + 1] = gamma[:, t] + filt[:, t] * (phi[:, t] - gamma[:, t])
    smooth = filt.copy()
    stay, arrive = np.empty_like(phi), np.empty_like(phi)
    for t in range(n_years - 2, -1, -1):
        after, f, p = smooth[:, t + 1], filt[:, t], pred[:, t + 1]
        stay[:, t] = f * phi[:, t] * after / p
        arrive[:, t] = (1 - f) * gamma[:, t] * after / p
        smooth[:, t] = stay[:, t] + f * (1 - phi[:, t]) * (1 - after) / (1 - p)
    out = [ll.sum(0)[:, None], np.full((len(theta), 1), float(n_sites)), smooth[:, 0].sum(0)[:, None]]
    species = len(theta)
    for design_rows, rate, weight, response in ((before, phi, smooth[:, :-1], stay), (now, gamma, 1 - smooth[:, :-1], arrive)):
        rows = design_rows.reshape(-1, design.rates)
        w, m = weight.reshape(-1, species), rate.reshape(-1, species)
        out += [(response.reshape(-1, species) - w * m).T @ rows, _gram(rows, w * m * (1 - m))]
    w, p = smooth.reshape(-1, species)[cell], np.exp(log_p)
    out += [(w * (k - n * p)).T @ z, _gram(z, w * n * p * (1 - p))]
    return np.concatenate(out, axis=1)


def _unpack(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.fromiter((len(x) for x in column), np.int64, len(column))


def _sites_sums(design: Design, rows: pa.RecordBatch, codes: np.ndarray, theta: np.ndarray) -> np.ndarray:
    x, _ = _unpack(rows.column("x"), np.float64)
    v, v_size = _unpack(rows.column("v"), np.float64)
    hits, h_size = _unpack(rows.column("hits"), np.int64)
    width = 1 + design.detection + design.offset
    v, hits = v.reshape(-1, width), hits.reshape(-1, 3)
    n_visits = v_size // width
    site_of = np.repeat(np.arange(len(rows)), n_visits)
    cell = site_of * design.years + v[:, 0].astype(np.int64)
    first = np.cumsum(n_visits) - n_visits
    seen = np.zeros((len(v), SHARE))
    seen[hits[:, 0] + np.repeat(first, h_size // 3), hits[:, 1] % SHARE] = hits[:, 2]
    return chain_sums(design, x.reshape(len(rows), design.years, design.rates), cell, v[:, 1:], seen[:, codes % SHARE], theta)


def _sums(survey: Survey, thetas: DataFrame, each: int) -> DataFrame:
    """(id, s): the sums of a step for each row (id, code, theta) of ``thetas``."""
    design, size = survey.design, survey.design.size
    share = F.floor(F.col("code") / SHARE).cast("int")
    listed = F.sort_array(F.collect_list(F.struct("id", "code", "theta")))
    packs = thetas.groupBy(share.alias("share")).agg(listed.alias("l")).select(
        "share", F.transform("l", lambda r: r["id"]).alias("ids"), F.transform("l", lambda r: r["code"]).alias("codes"), F.flatten(F.transform("l", lambda r: r["theta"])).alias("thetas")
    )
    rows = survey.sites.drop("site").join(survey.hinted(packs, each), "share")
    names = [f"s{i}" for i in range(design.sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = batch.column("share").to_numpy()
            for number in np.unique(shares):
                mine = batch.take(pa.array(np.flatnonzero(shares == number)))
                ids, codes = (np.array(mine.column(c)[0].as_py(), np.int64) for c in ("ids", "codes"))
                theta = np.array(mine.column("thetas")[0].as_py()).reshape(-1, size)
                at_once = max(1, AT_ONCE // (design.years * len(ids)))
                total = sum(_sites_sums(design, mine.slice(i, at_once), codes, theta) for i in range(0, len(mine), at_once))
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(total[:, i]) for i in range(design.sums))], names=["id", *names])

    partial = rows.mapInArrow(run, ", ".join(["id long", *(f"{n} double" for n in names)]))
    return partial.groupBy("id").agg(F.expr(f"array({', '.join(f'sum({n})' for n in names)})").alias("s"))


def _full(triangle: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = triangle
    return out + np.triu(out, 1).T


def read_sums(design: Design, s: np.ndarray) -> tuple[float, float, float, list[tuple[np.ndarray, np.ndarray]]]:
    """Log-likelihood, sites, expected occupied sites of the first year, and (gradient, Gram matrix) of the three regressions."""
    at, found = 3, []
    for k in (design.rates, design.rates, design.detection):
        triangle = k * (k + 1) // 2
        found.append((s[at : at + k], _full(s[at + k : at + k + triangle], k)))
        at += k + triangle
    return s[0], s[1], s[2], found


def newton(design: Design, s: np.ndarray, theta: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, next theta and score from the sums at ``theta`` under normal priors (no prior on the first year)."""
    ll, n, s0, regressions = read_sums(design, s)
    pull = precision * (theta - mean)
    objective = ll - 0.5 * float((pull * (theta - mean)).sum())
    after, score = theta.copy(), np.empty(design.size)
    share = min(max(s0 / n, 1e-6), 1 - 1e-6)
    after[0], score[0] = np.log(share / (1 - share)), s0 - n / (1 + np.exp(-theta[0]))
    for at, (gradient, gram) in zip(design.parts, regressions):
        slope = gradient - pull[at]
        score[at] = slope
        after[at] += np.linalg.solve(gram + np.diag(precision[at] + 1e-12), slope)
    return objective, after, score


def _evaluated(survey: Survey, prior: DataFrame, thetas: DataFrame) -> DataFrame:
    """Objective, next theta and score of every row of ``thetas``: by species, or by a struct that holds the species as __of beside a shift."""
    design = survey.design
    shifted = dict(thetas.dtypes)["species"] != "string"
    each = 2 * design.size if shifted else 1
    codes = survey.codes.withColumnRenamed("species", "__name")
    coded = thetas.withColumn("__name", F.col("species.__of") if shifted else F.col("species")).join(survey.hinted(codes), "__name").drop("__name")
    numbered = coded.withColumn("id", F.xxhash64("code", "species.at", "species.sign") if shifted else F.col("code").cast("long"))
    found = _sums(survey, numbered.select("id", "code", "theta"), each).join(survey.hinted(numbered, each), "id").join(survey.hinted(prior), "code")
    plain = "species " + dict(thetas.dtypes)["species"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [newton(design, *map(np.array, r)) for r in zip(*(batch.column(c).to_pylist() for c in ("s", "theta", "mean", "precision")))]
            doubles = pa.list_(pa.float64())
            values = [pa.array([r[0] for r in out], pa.float64()), *(pa.array([r[i].tolist() for r in out], doubles) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column("species"), *values], names=["species", "objective", "next", "score"])

    return found.select("species", "s", "theta", "mean", "precision").mapInArrow(run, f"{plain}, objective double, next array<double>, score array<double>")


def flat_prior(survey: Survey, precision: float = 0.01) -> DataFrame:
    """(code, mean, precision): the same wide normal around 0 for every coefficient; none on the first year's occupancy."""
    size = survey.design.size
    around = F.array_repeat(F.lit(0.0), size)
    return survey.codes.select("code", around.alias("mean"), F.transform(around, lambda x, i: F.when(i == 0, 0.0).otherwise(precision)).alias("precision"))


def start_thetas(survey: Survey) -> DataFrame:
    """All coefficients 0 but the intercepts: half the sites occupied at first, most stay, few are new, a third of the visits detect."""
    d = survey.design
    begin = np.zeros(d.size)
    begin[[d.parts[0].start, d.parts[1].start, d.parts[2].start]] = 1.5, -1.5, 0.0 if d.offset else -0.7
    return survey.codes.select("species", F.array(*map(F.lit, begin.tolist())).alias("theta"))


def fit(survey: Survey, prior: DataFrame | None = None, start: DataFrame | None = None, iterations: int = 200, tolerance: float = 1e-4, leaps: bool = True, errors: bool = True, warm: int = 10) -> DataFrame:
    """The posterior mode per species: (species, theta, objective, iterations, converged, errors, variances).

    ``theta`` follows ``survey.names``: the logit of the first year's occupancy, then intercept
    and slopes of persistence, colonisation and detection.  ``prior`` (code, mean, precision) defaults to a wide normal,
    which keeps coefficients finite where a species is seen at all visits or at none.  EM steps with
    squared extrapolation come first, for at most ``warm`` passes, then Newton steps (each reads the survey for
    two shifts of every coefficient); without ``leaps`` plain EM steps alone.
    """
    prior = settle(flat_prior(survey) if prior is None else prior)
    step = lambda thetas: _evaluated(survey, prior, thetas)
    begin = start_thetas(survey) if start is None else start
    fitted = fitting.finished(step, step, begin, iterations=iterations, tolerance=tolerance, warm=warm) if leaps else fitting.accelerated(step, begin, iterations=iterations, tolerance=tolerance, leaps=False)
    return fitting.with_errors(step, fitted) if errors else fitted


def coefficients(survey: Survey, fitted: DataFrame) -> DataFrame:
    """Long form: (species, parameter, estimate[, error]) with the names of ``survey``."""
    names = F.array(*map(F.lit, survey.names))
    error = [F.get("errors", F.col("pos")).alias("error")] if "errors" in fitted.columns else []
    return fitted.select("*", F.posexplode("theta").alias("pos", "estimate")).select("species", F.get(names, F.col("pos")).alias("parameter"), "estimate", *error)


def group_moments(fitted: DataFrame, groups: DataFrame, key: str, design: Design, spread_floor: float = 1e-3) -> DataFrame:
    """(key, mean, variance) of each coefficient over the species of a group.

    The variance adds the species' own uncertainty to their spread, as an EM step for a normal
    random effect does; it stays above ``spread_floor``.
    """
    size = design.size
    rows = fitted.join(groups, "species").select(key, "theta", F.coalesce("variances", F.array_repeat(F.lit(0.0), size * size)).alias("v"))
    at = lambda i: F.get("theta", F.lit(i))
    sums = rows.groupBy(key).agg(
        F.array(*[F.avg(at(i)) for i in range(size)]).alias("mean"),
        F.array(*[F.greatest(F.lit(spread_floor), F.var_pop(at(i)) + F.avg(F.get("v", F.lit(i * size + i)))) for i in range(size)]).alias("variance"),
    )
    return sums


def fit_groups(survey: Survey, groups: DataFrame, key: str = "trait", rounds: int = 30, tolerance: float = 1e-3, inner: int = 100, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Species whose coefficients vary around those of their group: (species fits, group means and variances).

    Two levels take turns: species are fitted under their group's normal prior,
    from where they were; then each group's means and variances follow from its species'
    modes and their covariances (EM with a normal approximation of each species).  Rounds end when no
    group mean moves by more than ``tolerance``; the last column of the groups says whether they did.
    A species without a group keeps the wide prior of ``flat_prior``.
    """
    wide = settle(flat_prior(survey))
    fitted = settle(fit(survey, wide, start, inner))
    members = settle(groups.select("species", key).dropna())
    moments = settle(group_moments(fitted, members, key, survey.design))
    ended = F.lit(False)
    for k in range(rounds):
        own = members.join(checked_broadcast(moments, settled=True), key).join(survey.codes, "species").select(
            "code", F.col("mean").alias("m"), F.transform("variance", lambda v, i: F.when(i == 0, 0.0).otherwise(1 / v)).alias("w")
        )
        prior = wide.join(own, "code", "left").select("code", F.coalesce("m", "mean").alias("mean"), F.coalesce("w", "precision").alias("precision"))
        fitted = settle(fit(survey, prior, fitted.select("species", "theta"), inner))
        after = settle(group_moments(fitted, members, key, survey.design))
        moved = after.join(moments.select(key, F.col("mean").alias("was")), key).agg(F.max(F.array_max(F.zip_with(F.slice("mean", 2, survey.design.size), F.slice("was", 2, survey.design.size), lambda x, y: F.abs(x - y))))).first()[0]
        moments = after
        if moved is None or moved <= tolerance:
            ended = F.lit(True)
            break
    return fitted, moments.withColumn("converged", ended)
