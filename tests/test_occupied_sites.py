"""The distribution of occupied sites against enumeration, and blocks against one chain."""

import itertools
import random

import numpy as np
import pytest

from fieldmark.plans import occupied_sites as D


def enumerated(ps):
    out = np.zeros(len(ps) + 1)
    for z in itertools.product((0, 1), repeat=len(ps)):
        out[sum(z)] += np.prod([p if k else 1 - p for p, k in zip(ps, z)])
    return out


def dense(first, masses, n):
    out = np.zeros(n + 1)
    out[first : first + len(masses)] = masses
    return out


def test_chain_equals_enumeration():
    r = random.Random(1)
    for n in (1, 2, 7, 10):
        ps = [r.choice([0.0, 1.0, r.random()]) for _ in range(n)]
        assert dense(*D.of_sites(ps), n) == pytest.approx(enumerated(ps), abs=1e-15)


def test_quantiles_of_a_fair_coin():
    first, masses = D.of_sites([0.5] * 10)
    assert [D.quantile(first, masses, q) for q in (0.0, 0.001, 0.025, 0.5, 0.975, 1.0)] == [0, 1, 2, 5, 8, 10]


@pytest.mark.parametrize("block, fan", [(512, 16), (3, 2)])
def test_blocks_make_no_difference(spark, block, fan):
    r = random.Random(2)
    rows = [(k, 2004, s, r.random()) for k, n in (("a", 9), ("b", 40), ("c", 1)) for s in range(n)] + [("a", 2005, 1, 1.0), ("a", 2005, 2, 0.0), ("a", 2005, 3, None)]
    df = spark.createDataFrame(rows, "species string, year int, site long, z_prob double")
    found = D.occupied_distribution(df, block=block, fan=fan)
    got = {(x.species, x.year): x for x in found.collect()}
    assert set(got) == {("a", 2004), ("b", 2004), ("c", 2004), ("a", 2005)}
    for (k, y), x in got.items():
        ps = [p for kk, yy, _, p in rows if (kk, yy) == (k, y) and p is not None]
        assert x.n_sites == len(ps) and sum(x.masses) == pytest.approx(1.0)
        assert dense(x.first, x.masses, len(ps)) == pytest.approx(dense(*D.of_sites(ps), len(ps)), abs=1e-14)
    bounds = {(x.species, x.year): x for x in D.occupied_bounds(found).collect()}
    b = bounds["a", 2005]
    assert (b.mean, b.sd, b.lower, b.upper, b.upper_percent) == (1.0, 0.0, 1, 1, 50.0)
    ps = [p for k, y, _, p in rows if k == "b"]
    assert bounds["b", 2004].mean == pytest.approx(sum(ps)) and bounds["b", 2004].sd == pytest.approx(sum(p * (1 - p) for p in ps) ** 0.5)


def test_no_sites_no_rows(spark):
    df = spark.createDataFrame([], "species string, year int, site long, z_prob double")
    assert D.occupied_bounds(D.occupied_distribution(df)).count() == 0
