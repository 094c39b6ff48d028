"""The chain against enumeration of all hidden states; the fits against direct maxima."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldmark.plans import occupancy as O
from fieldmark.plans import scores

HIST = "site int, species string, h array<struct<t:int,k:int>>"


def enumerate_chain(h, psi1, phi, gamma, p):
    """Likelihood and smoothed probabilities by summing over every z."""
    n = len(h)
    total, on = 0.0, [0.0] * n
    for z in itertools.product((0, 1), repeat=n):
        pr = psi1 if z[0] else 1 - psi1
        for i in range(1, n):
            up = phi if z[i - 1] else gamma
            pr *= up if z[i] else 1 - up
        for (t, k), zi in zip(h, z):
            pr *= p**k * (1 - p) ** (t - k) if zi else float(k == 0)
        total += pr
        for i in range(n):
            on[i] += pr * z[i]
    return math.log(total), [x / total for x in on]


CASES = [[(3, 0), (0, 0), (2, 1), (4, 0)], [(2, 2), (3, 0), (1, 0), (0, 0)], [(1, 0), (1, 0), (1, 0), (1, 0)]]


def fixed(spark, n):
    table = spark.createDataFrame([("a", 0.4, 0.8, 0.15, 0.3)], "species string, psi1 double, phi double, gamma double, p double")
    return O.constant_parameters(table, n)


def test_likelihood_and_smoothing_match_enumeration(spark):
    df = spark.createDataFrame([(i, "a", h) for i, h in enumerate(CASES)], HIST)
    ll = {r.site: r for r in O.history_loglik(df, fixed(spark, 4), 4).collect()}
    smooth = {(r.site, r.year): r.z_prob for r in O.smoothed_occupancy(df, fixed(spark, 4), range(2000, 2004)).collect()}
    for i, h in enumerate(CASES):
        want, on = enumerate_chain(h, 0.4, 0.8, 0.15, 0.3)
        assert ll[i].loglik == pytest.approx(want)
        assert ll[i].filtered == pytest.approx(on[-1])
        assert [smooth[i, 2000 + t] for t in range(4)] == pytest.approx(on)


def test_one_year_and_many_replicates_do_not_underflow(spark):
    df = spark.createDataFrame([(1, "a", [(92, 0)]), (2, "a", [(92, 92)])], HIST)
    got = {r.site: r.loglik for r in O.history_loglik(df, fixed(spark, 1), 1).collect()}
    assert got[1] == pytest.approx(math.log(0.4 * 0.7**92 + 0.6))
    assert got[2] == pytest.approx(math.log(0.4) + 92 * math.log(0.3))
    assert O.smoothed_occupancy(df, fixed(spark, 1), range(2000, 2001)).count() == 2


def test_visit_level_detection_gives_the_same_likelihood(spark):
    """Evidence summed from single visits equals the count form when p is constant."""
    visits = [
        (i, "a", 2000 + y, 0.3, 1 if v < k else 0)
        for i, h in enumerate(CASES) for y, (t, k) in enumerate(h) for v in range(t)
    ]
    scored = spark.createDataFrame(visits, "site int, species string, year int, p double, y int")
    packed = O.pack_emissions(O.visit_emissions(scored), range(2000, 2004)).join(fixed(spark, 4).drop("p"), "species")
    got = {r.site: r.loglik for r in O.loglik_of(packed, 4).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([enumerate_chain(h, 0.4, 0.8, 0.15, 0.3)[0] for h in CASES])


def simulated(n_sites=300, years=4, seed=7):
    r = random.Random(seed)
    out = []
    for s in range(n_sites):
        z, h = r.random() < 0.6, []
        for y in range(years):
            if y:
                z = r.random() < (0.85 if z else 0.2)
            t = r.randrange(0, 5)
            h.append((t, sum(z and r.random() < 0.5 for _ in range(t))))
        out.append((s, "a", h))
    return out


def test_em_climbs_and_its_last_step_hardly_moves(spark):
    df = spark.createDataFrame(simulated(), HIST)
    grouped = O.settle(O.grouped_histories(df))
    q, path = O.settle(O.start_parameters(grouped, 4)), []
    for _ in range(6):
        q = O.settle(O.em_maximise(O.em_sums(grouped, q.drop("loglik"), 4), 4, by_year=False))
        path.append(q.first().loglik)
    assert all(b >= a - 1e-9 for a, b in zip(path, path[1:]))
    fit = O.fit_dynamic(df, 4, iterations=60, tolerance=1e-7).first()
    assert fit.converged and fit.iterations < 60
    assert fit.loglik >= path[-1]
    assert (fit.phi[0], fit.gamma[0], fit.p[0]) == (pytest.approx(0.85, abs=0.1), pytest.approx(0.2, abs=0.1), pytest.approx(0.5, abs=0.06))


def test_em_step_matches_enumeration(spark):
    df = spark.createDataFrame([(i, "a", h) for i, h in enumerate(CASES)], HIST)
    start = fixed(spark, 4).withColumn("loglik", F.lit(None).cast("double"))
    got = O.fit_dynamic(df, 4, start, iterations=1, tolerance=0).first()
    smooth = [enumerate_chain(h, 0.4, 0.8, 0.15, 0.3) for h in CASES]
    assert got.psi1 == pytest.approx(sum(s[0] for _, s in smooth) / 3)
    hit = sum(s[i] * h[i][1] for (_, s), h in zip(smooth, CASES) for i in range(4))
    tried = sum(s[i] * h[i][0] for (_, s), h in zip(smooth, CASES) for i in range(4))
    assert got.p[0] == pytest.approx(hit / tried)
    here = [enumerate_chain(h, got.psi1, got.phi[0], got.gamma[0], got.p[0])[0] for h in CASES]
    assert got.loglik == pytest.approx(sum(here))
    assert (got.iterations, got.converged) == (1, False)


def test_each_species_stops_by_itself(spark):
    """One species that is settled after a step beside one that moves for long; an empty table ends at once."""
    slow = [(i, "slow", h) for i, _, h in simulated(60)]
    quick = [(i, "quick", [(1, 1)] * 4) for i in range(40)]
    df = spark.createDataFrame(slow + quick, HIST)
    got = {r.species: r for r in O.fit_dynamic(df, 4, iterations=12, tolerance=1e-9).collect()}
    assert got["quick"].converged and got["quick"].iterations < got["slow"].iterations == 12 and not got["slow"].converged
    alone = O.fit_dynamic(spark.createDataFrame(slow, HIST), 4, iterations=12, tolerance=1e-9).first()
    assert got["slow"].loglik == pytest.approx(alone.loglik) and got["slow"].p == pytest.approx(alone.p)
    assert O.fit_dynamic(df.limit(0), 4).count() == 0


def test_visits_outside_the_years_are_counted(spark):
    lists = spark.createDataFrame([(1, 1999), (2, 2000), (3, None), (4, 2003)], "event_id int, year int")
    got = {r.year: r.n_lists for r in O.visits_outside(lists, range(2000, 2003)).collect()}
    assert got == {1999: 1, None: 1, 2003: 1}


def test_yearly_parameters_fit_at_least_as_well(spark):
    df = spark.createDataFrame(simulated(200), HIST)
    constant = O.fit_dynamic(df, 4, iterations=8, tolerance=0).first()
    yearly = O.fit_dynamic(df, 4, iterations=8, tolerance=0, by_year=True).first()
    assert len(yearly.p) == 4
    assert yearly.loglik >= constant.loglik - 0.5


def test_single_season_against_a_grid(spark):
    r = random.Random(11)
    sites = [(r.randrange(2, 7), r.random() < 0.4) for _ in range(400)]
    counts = {}
    for t, z in sites:
        k = sum(z and r.random() < 0.6 for _ in range(t))
        counts[k, t] = counts.get((k, t), 0) + 1
    df = spark.createDataFrame([("a", k, t, w) for (k, t), w in counts.items()], "species string, k int, t int, w long")
    assert not O.fit_single_season(df, iterations=2).first().converged
    fit = O.fit_single_season(df, iterations=500, tolerance=1e-10).first()
    assert fit.converged

    def loglik(psi, p):
        return sum(
            w * math.log(psi * p**k * (1 - p) ** (t - k) + (1 - psi) * (k == 0)) for (k, t), w in counts.items()
        )

    best = max(loglik(i / 200, j / 200) for i in range(1, 200) for j in range(1, 200))
    assert loglik(fit.psi, fit.p) >= best - 1e-6
    assert fit.n_occ >= sum(w for (k, _), w in counts.items() if k > 0)


def test_trajectory_stays_a_probability_and_guards_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 0.9, 0.0), ("b", 0.3, 0.7, 0.1)], "species string, psi1 double, phi double, gamma double")
    got = O.psi_trajectory(df, range(2004, 2015)).collect()
    assert len(got) == 22 and all(0 <= r.psi <= 1 for r in got)
    assert all(r.growth is None and r.turnover is None for r in got if r.species == "a")


def test_prior_year_skips_gaps(spark):
    df = spark.createDataFrame([(1, 2006, 0.5), (1, 2008, 0.7), (1, 2009, 0.9)], "site int, year int, temp double")
    got = {r.year: r.temp_prev for r in scores.with_prior_year(df, ["temp"]).collect()}
    assert got == {2006: None, 2008: None, 2009: 0.7}


def test_more_species_than_one_array_holds(spark):
    facts = spark.range(3).toDF("v")
    table = spark.createDataFrame([(f"s{i}", float(i)) for i in range(25)], "species string, a double")
    out = scores.per_species(facts, table, max_species=4)
    assert out.count() == 75 and out.distinct().count() == 75


def test_trend_classes(spark):
    data = [("up", y, 0.1 * y + 0.001 * (y % 2)) for y in range(6)]
    data += [("down", y, -0.1 * y + 0.001 * (y % 2)) for y in range(6)] + [("flat", y, float(y % 2)) for y in range(6)]
    df = spark.createDataFrame(data, "species string, year int, psi double")
    got = {r.species: r.trend for r in O.species_trend(df).collect()}
    assert got == {"up": "increasing", "down": "declining", "flat": "stable"}
