"""The covariate model: likelihood by enumeration of hidden states, maximum by dense Newton steps, two-level moments."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.plans import covariate_fit as C
from fieldmark.plans import fitting
from fieldmark.session import settle

YEARS = range(2004, 2007)


def made_up(n_sites=80, species=("a", "b"), seed=5):
    """Sites with one static and one yearly covariate; visits with one covariate; detections from a simulated chain."""
    r = random.Random(seed)
    s = lambda x: 1 / (1 + math.exp(-x))
    panel, lists, found, event = [], [], [], 0
    for j in range(n_sites):
        forest = r.uniform(-1, 1)
        temp = {y: r.uniform(-1, 1) for y in YEARS}
        panel += [(j, y, forest, temp[y]) for y in YEARS]
        z = {k: r.random() < 0.6 for k in species}
        for y in YEARS:
            if y > YEARS.start:
                for i, k in enumerate(species):
                    stay = s(1.0 + 0.8 * forest - 0.5 * i * temp[y - 1])
                    come = s(-1.0 + 0.6 * temp[y])
                    z[k] = r.random() < (stay if z[k] else come)
            for _ in range(r.randint(0, 4)):
                effort = r.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
                lists.append((event, j, y, effort))
                found += [(event, k) for k in species if z[k] and r.random() < s(0.3 + 0.9 * effort)]
                event += 1
    return panel, lists, found


def survey_of(spark, panel, lists, found, species):
    return C.pack(
        spark.createDataFrame(lists, "event_id long, site long, year int, effort double"),
        spark.createDataFrame(found + found[:5], "event_id long, species string"),
        spark.createDataFrame([(k,) for k in species], "species string"),
        spark.createDataFrame(panel, "site long, year int, forest double, temp double"),
        YEARS, ["forest"], ["temp"], ["effort"],
    )


def dense_objective(panel, lists, found, species, theta, precision=0.01):
    """Log-posterior from a sum over all paths of hidden states."""
    s = lambda x: 1 / (1 + math.exp(-x))
    cover = {(j, y): (f, t) for j, y, f, t in panel}
    seen = {e for e, k in found if k == species}
    total = 0.0
    for j in {j for j, *_ in panel}:
        mine = {y: [(w, e in seen) for e, i, yy, w in lists if i == j and yy == y] for y in YEARS}
        if not any(mine.values()):
            continue  # a site without visits is not packed: it says nothing
        like = 0.0
        for path in itertools.product((0, 1), repeat=len(YEARS)):
            p = s(theta[0]) if path[0] else 1 - s(theta[0])
            for t, y in enumerate(YEARS):
                if t:
                    f0, t0 = cover[j, y - 1]
                    f1, t1 = cover[j, y]
                    up = s(theta[1] + theta[2] * f0 + theta[3] * t0) if path[t - 1] else s(theta[4] + theta[5] * f1 + theta[6] * t1)
                    p *= up if path[t] else 1 - up
                for w, hit in mine[y]:
                    q = path[t] * s(theta[7] + theta[8] * w)
                    p *= q if hit else 1 - q
            like += p
        total += math.log(like)
    return total - 0.5 * precision * sum(x * x for x in theta[1:])


def derivatives(f, x, h=1e-3):
    n = len(x)
    e = np.eye(n) * h
    g = np.array([(f(x + e[i]) - f(x - e[i])) / (2 * h) for i in range(n)])
    m = np.array([[(f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * h * h) for j in range(n)] for i in range(n)])
    return g, m


@pytest.fixture(scope="module")
def case(spark):
    data = made_up()
    return data, survey_of(spark, *data, ("a", "b", "nobody"))


@pytest.fixture(scope="module")
def fitted(case):
    """Three steps of all species and their standard errors there."""
    return {r.species: r for r in C.fit(case[1], iterations=3).collect()}


def test_objective_is_the_sum_over_hidden_states(spark, case):
    data, survey = case
    prior = settle(C.flat_prior(survey))
    theta = [0.2, 0.9, 0.3, -0.2, -0.8, 0.1, 0.4, 0.1, 0.6]
    at = spark.createDataFrame([("a", theta), ("b", [x / 2 for x in theta])], "species string, theta array<double>")
    got = {r.species: r.objective for r in C._evaluated(survey, prior, at).collect()}
    assert got["a"] == pytest.approx(dense_objective(*data, "a", theta), abs=1e-8)
    assert got["b"] == pytest.approx(dense_objective(*data, "b", [x / 2 for x in theta]), abs=1e-8)


def test_score_is_the_gradient(spark, case):
    data, survey = case
    theta = np.array([0.2, 0.9, 0.3, -0.2, -0.8, 0.1, 0.4, 0.1, 0.6])
    at = spark.createDataFrame([("a", theta.tolist())], "species string, theta array<double>")
    score = C._evaluated(survey, settle(C.flat_prior(survey)), at).first().score
    f = lambda x: dense_objective(*data, "a", x)
    want = [(f(theta + d) - f(theta - d)) / 2e-4 for d in np.eye(9) * 1e-4]
    assert score == pytest.approx(want, abs=1e-4)


def in_memory(data, species, leaps, tolerance=1e-5, most=2000):
    """The same iteration without Spark."""
    panel, lists, found = data
    cover, sites = {(j, y): (f, t) for j, y, f, t in panel}, sorted({j for _, j, _, _ in lists})
    seen = {e for e, k in found if k == species}
    rows = sorted((sites.index(j) * len(YEARS) + y - YEARS.start, w, e in seen) for e, j, y, w in lists)
    x = np.array([[[1.0, *cover[j, y]] for y in YEARS] for j in sites])
    cell, v, k = np.array([r[0] for r in rows]), np.array([[1.0, r[1]] for r in rows]), np.array([[float(r[2])] for r in rows])
    design, start = C.Design(len(YEARS), 3, 2), np.array([0, 1.5, 0, 0, -1.5, 0, 0, -0.7, 0.0])
    mean, precision = np.zeros(9), np.array([0.0] + [0.01] * 8)
    row = fitting.Row(start, None, start, start, False, False, 0, False, False)
    while not row.done and row.iterations < most:
        sums = C.chain_sums(design, x, cell, v, k, row.here[None])[0]
        objective, after, _ = C.newton(design, sums, row.here, mean, precision)
        row = row.after(objective, after, tolerance, leaps)
    return row


@pytest.mark.parametrize("species", ["a", "b"])
def test_the_end_is_the_dense_maximum(case, species):
    plain, leaping = in_memory(case[0], species, False), in_memory(case[0], species, True)
    assert plain.converged and leaping.converged and leaping.iterations < 0.7 * plain.iterations
    assert plain.best == pytest.approx(leaping.best, abs=1e-5)
    f = lambda x: dense_objective(*case[0], species, x)
    gradient, hessian = derivatives(f, leaping.good)
    assert np.abs(np.linalg.solve(hessian, gradient)).max() < 2e-3 and np.linalg.eigvalsh(hessian).max() < 0  # a dense Newton step moves nowhere
    assert leaping.best == pytest.approx(f(leaping.good), abs=1e-8)


@pytest.mark.parametrize("species", ["a", "b", "nobody"])
def test_jobs_do_the_same_as_the_loop_in_memory(case, fitted, species):
    row = fitted[species]
    want = in_memory(case[0], species, True, most=3)
    assert row.theta == pytest.approx(want.good.tolist(), abs=1e-8) and row.objective == pytest.approx(want.best, abs=1e-8)
    assert (row.iterations, row.converged) == (3, False) and np.isfinite(row.theta).all()


def test_errors_come_from_the_observed_information(case, fitted):
    row = fitted["a"]
    _, hessian = derivatives(lambda x: dense_objective(*case[0], "a", x), np.array(row.theta))
    want = np.linalg.inv(-hessian)
    assert row.variances == pytest.approx(want.ravel().tolist(), rel=5e-2, abs=2e-3)
    assert row.errors == pytest.approx(np.sqrt(np.diag(want)).tolist(), rel=2e-2)


def test_names_follow_theta(case, fitted, spark):
    rows = C.coefficients(case[1], spark.createDataFrame([(k, r.theta, r.errors) for k, r in fitted.items()], "species string, theta array<double>, errors array<double>")).where("species = 'a'").collect()
    got = {r.parameter: r.estimate for r in rows}
    assert list(case[1].names) == ["psi1", "phi_0", "phi_forest", "phi_temp", "gamma_0", "gamma_forest", "gamma_temp", "p_0", "p_effort"]
    assert [got[n] for n in case[1].names] == fitted["a"].theta


def test_incomplete_sites_and_visits_are_left_out(spark):
    panel, lists, found = made_up(12)
    holes = [(j, y, None if (j, y) == (3, 2005) else f, t) for j, y, f, t in panel]
    survey = survey_of(spark, holes, [*lists, (10_000, 1, 2004, None), (10_001, 1, 1999, 0.5)], found, ("a", "b"))
    visited = {j for _, j, _, _ in lists} - {3}
    assert {r.site for r in survey.sites.collect()} == visited
    n = survey.sites.where("site = 1").select(F.expr("aggregate(sequence(0, size(v) div 3 - 1), 0D, (a, i) -> a + v[3 * i + 1])")).first()[0]
    assert n == sum(j == 1 for _, j, _, _ in lists)


def test_many_species_go_in_shares(spark, case, monkeypatch):
    monkeypatch.setattr(C, "SHARE", 2)
    monkeypatch.setattr(C, "AT_ONCE", 8)
    data, whole = case
    split = survey_of(spark, *data, ("a", "b", "nobody"))
    assert split.sites.select("share").distinct().count() == 2
    thetas = [(k, [0.1 * i] * 9) for i, k in enumerate(("a", "b", "nobody"))]
    got = {r.species: r.objective for r in C._evaluated(split, settle(C.flat_prior(split)), spark.createDataFrame(thetas, "species string, theta array<double>")).collect()}
    for k, theta in thetas:
        assert got[k] == pytest.approx(dense_objective(*data, k, theta), abs=1e-8)


def test_group_moments_add_uncertainty(spark):
    d = C.Design(3, 1, 1)
    rows = [("a", [0.0, 1.0, 2.0, 3.0], [0.5] + [0.0] * 4 + [0.25] + [0.0] * 10), ("b", [2.0, 3.0, 2.0, 5.0], None)]
    fitted = spark.createDataFrame(rows, "species string, theta array<double>, variances array<double>")
    groups = spark.createDataFrame([("a", "x"), ("b", "x")], "species string, trait string")
    row = C.group_moments(fitted, groups, "trait", d).first()
    assert row["mean"] == [1.0, 2.0, 2.0, 4.0] and row["variance"] == pytest.approx([1.25, 1.125, 1e-3, 1.0])


def test_groups_pull_their_species_together(spark, case, fitted):
    groups = spark.createDataFrame([("a", "x"), ("b", "x")], "species string, trait string")
    begin = spark.createDataFrame([(k, r.theta) for k, r in fitted.items()], "species string, theta array<double>")
    fits, moments = C.fit_groups(case[1], groups, rounds=1, inner=2, start=begin)
    rows, (group,) = {r.species: r for r in fits.collect()}, moments.collect()
    # the moments are those of the returned modes and covariances
    d = case[1].design.size
    for i in range(1, d):
        theta = [rows[k].theta[i] for k in "ab"]
        own = [rows[k].variances[i * d + i] if rows[k].variances else 0.0 for k in "ab"]
        assert group["mean"][i] == pytest.approx(np.mean(theta)) and group["variance"][i] == pytest.approx(max(1e-3, np.var(theta) + np.mean(own)))
    assert set(rows) == {"a", "b", "nobody"} and not group["converged"]


def test_leaps_reach_a_known_point():
    """EM-like steps that close a tenth of the way to a known point."""
    goal = np.array([1.0, 2.0])

    def run(leaps):
        start = np.array([5.0, -3.0])
        row = fitting.Row(start, None, start, start, False, False, 0, False, False)
        while not row.done:
            row = row.after(-float(((row.here - goal) ** 2).sum()), row.here + (goal - row.here) / 10, 1e-6, leaps)
        return row

    fast, slow = run(True), run(False)
    assert fast.iterations < slow.iterations / 10 and fast.good == pytest.approx(goal, abs=1e-4) and slow.good == pytest.approx(goal, abs=1e-4)


def test_a_step_that_falls_is_halved_and_a_leap_that_falls_is_taken_back():
    a = np.array([0.0])
    row = fitting.Row(a, -1.0, np.array([4.0]), a, False, True, 3, False, False).after(-2.0, np.array([9.0]), 1e-6, True)
    assert row.here == [2.0] and row.good == [0.0] and row.best == -1.0 and not row.pure
    row = fitting.Row(a, -1.0, np.array([4.0]), np.array([1.0]), True, False, 3, False, False).after(float("nan"), np.array([9.0]), 1e-6, True)
    assert row.here == [1.0] and row.good == [0.0] and row.pure and not row.leaping


def test_newton_steps_end_a_quadratic_at_once(spark):
    goal, curve = np.array([1.0, -2.0]), np.array([[2.0, 0.5], [0.5, 1.0]])
    row = lambda a: F.array(*[F.lit(float(x)) for x in a])
    gaps = lambda t: t.withColumn("gap", F.zip_with("theta", row(goal), lambda x, g: x - g))
    dot = lambda a: F.aggregate(F.zip_with(row(a), "gap", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = lambda t: gaps(t).select("species", F.array(*[-dot(c) for c in curve]).alias("score"))
    objective = -0.5 * (F.get("gap", F.lit(0)) * dot(curve[0]) + F.get("gap", F.lit(1)) * dot(curve[1]))
    step = lambda t: gaps(t).select("species", objective.alias("objective"), F.col("theta").alias("next"))
    start = spark.createDataFrame([("a", [9.0, 9.0]), ("b", [0.0, 0.0])], "species string, theta array<double>")
    for r in fitting.accelerated(fitting.newton_steps(step, score), start, leaps=False).collect():
        assert r.converged and r.iterations <= 3 and r.theta == pytest.approx(goal.tolist(), abs=1e-6)
    fitted = fitting.with_errors(score, start.withColumn("objective", F.lit(0.0))).first()
    assert fitted.variances == pytest.approx(np.linalg.inv(curve).ravel().tolist(), rel=1e-5)


def test_score_of_the_constant_model_is_the_gradient_of_its_likelihood(spark):
    from fieldmark.plans import occupancy as O

    r = random.Random(4)
    rows = [("a", [(t := r.randint(0, 3), r.randint(0, t)) for _ in range(4)]) for _ in range(30)]
    grouped = O.grouped_histories(spark.createDataFrame(rows, "species string, h array<struct<t:int,k:int>>"))
    theta, h = [0.3, 0.8, -0.6, -0.2], 1e-4
    around = fitting._scores_around(lambda t: O._em_score(grouped, t, 4), spark.createDataFrame([("a", theta)], "species string, theta array<double>"), "species", h).first()
    slope, info = fitting.information(around["__scores"], h)

    def loglik(theta):
        psi, phi, gamma, p = (1 / (1 + math.exp(-x)) for x in theta)
        total = 0.0
        for _, years in rows:
            like = 0.0
            for path in itertools.product((0, 1), repeat=4):
                q = psi if path[0] else 1 - psi
                for i, (t, k) in enumerate(years):
                    if i:
                        up = phi if path[i - 1] else gamma
                        q *= up if path[i] else 1 - up
                    q *= p**k * (1 - p) ** (t - k) if path[i] else float(k == 0)
                like += q
            total += math.log(like)
        return total

    gradient, hessian = derivatives(loglik, np.array(theta))
    assert slope == pytest.approx(gradient, abs=1e-4) and -info == pytest.approx(hessian, abs=1e-2)
