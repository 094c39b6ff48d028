import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import posterior as D


def draws(n, seed=5):
    r = random.Random(seed)
    hot = [("hot", 1.0 if r.random() < 0.33 else r.gauss(0, 2)) for _ in range(n)]
    return hot + [("tiny", float(i)) for i in range(7)] + [("one", 4.0)] + [("flat", 2.5)] * 90


@pytest.mark.parametrize("accuracy", [40, 400, 10_000])
def test_exact_quantiles_of_small_and_large_groups(spark, accuracy):
    """A third of the hot group are ties; small accuracies force the bracketing."""
    data = draws(5000)
    df = spark.createDataFrame(data, "parameter string, value double").repartition(6)
    got = {r.parameter: r for r in D.exact_quantiles(df, ["parameter"], accuracy=accuracy).collect()}
    for p in ("hot", "tiny", "one", "flat"):
        v = [x for q, x in data if q == p]
        assert got[p].n == len(v)
        assert list(got[p].quantiles) == pytest.approx(list(np.quantile(v, D.QUANTILES)), abs=1e-12)


def test_quantiles_leave_out_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "parameter string, value double")
    assert D.exact_quantiles(df, ["parameter"]).first().quantiles[2] == 2.0


def test_histogram_counts_sum_to_n_and_density_to_one(spark):
    data = draws(2000)
    df = spark.createDataFrame(data, "parameter string, value double")
    got = D.histogram_density(df, ["parameter"], 0.1).groupBy("parameter").agg(F.sum("n"), F.sum(F.col("density") * 0.1))
    for p, n, area in got.collect():
        assert n == sum(1 for q, _ in data if q == p)
        assert area == pytest.approx(1.0)


def test_fifty_bins_cover_the_range(spark):
    df = spark.createDataFrame(draws(2000), "parameter string, value double")
    got = D.histogram_bins(df, ["parameter"], 50)
    assert got.where("parameter = 'hot'").agg(F.max("bin") - F.min("bin")).first()[0] in (49, 50)
    assert got.where("parameter = 'flat'").count() == 1


def test_kernel_density_integrates_to_one_and_follows_the_draws(spark):
    r = random.Random(3)
    v = [r.gauss(1, 0.5) for _ in range(3000)]
    df = spark.createDataFrame([("a", x) for x in v], "parameter string, value double")
    got = D.kernel_density(df, ["parameter"]).orderBy("point").collect()
    step = got[1].x - got[0].x
    assert sum(g.density for g in got) * step == pytest.approx(1.0, abs=0.003)
    q75, q25 = np.quantile(v, [0.75, 0.25])
    bw = 0.9 * min(np.std(v, ddof=1), (q75 - q25) / 1.34) * len(v) ** -0.2
    for g in got[100:400:60]:
        direct = np.mean(np.exp(-0.5 * ((g.x - np.array(v)) / bw) ** 2)) / (bw * math.sqrt(2 * math.pi))
        assert g.density == pytest.approx(direct, abs=2e-3)


def test_kernel_density_of_groups_without_spread(spark):
    """A point mass has a bandwidth from its size, else from 1; a missing key is a group."""
    rows = [("flat", 2.0)] * 5 + [("nought", 0.0)] * 5 + [(None, 1.0), (None, 3.0), ("one", 4.0)]
    got = D.kernel_density(spark.createDataFrame(rows, "parameter string, value double"), ["parameter"], points=201)
    areas = {r[0]: r for r in got.groupBy("parameter").agg(F.count("*"), F.sum("density") * (F.max("x") - F.min("x")) / 200, F.max("x") - F.min("x")).collect()}
    assert set(areas) == {"flat", "nought", None, "one"} and all(r[1] == 201 and r[2] == pytest.approx(1.0, abs=0.01) for r in areas.values())
    assert areas["flat"][3] == pytest.approx(6 * 0.9 * 2 * 5**-0.2) and areas["nought"][3] == pytest.approx(6 * 0.9 * 5**-0.2)


def test_rhat_against_its_formula(spark):
    r = np.random.default_rng(1)
    chains = [r.normal(m, 1, 200) for m in (0.0, 0.1, 0.6)]
    data = [(k, "a", float(x)) for k, c in enumerate(chains) for x in c]
    df = spark.createDataFrame(data, "chain int, parameter string, value double")
    w, b = np.mean([c.var(ddof=1) for c in chains]), np.var([c.mean() for c in chains], ddof=1)
    want = math.sqrt((199 / 200 * w + b) / w)
    assert D.rhat(df).first().rhat == pytest.approx(want)
    assert D.converged(D.rhat(df), want - 1e-6).count() == 0


def test_trace_and_chains(spark):
    one = spark.createDataFrame([("a", 5, 0.1), ("a", 9, 0.2)], "parameter string, draw_id long, value double")
    both = D.union_chains([one, one])
    got = D.trace_table(both).orderBy("chain", "iteration").collect()
    assert [(r.chain, r.iteration, r.value) for r in got] == [(1, 1, 0.1), (1, 2, 0.2), (2, 1, 0.1), (2, 2, 0.2)]


def test_flatten_keeps_true_indices(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "sim int, a array<array<double>>")
    got = {(r.i1, r.i2): r.value for r in D.flatten_array(df, "a", ["sim"], 2).collect()}
    assert got[(2, 1)] == 4.0 and got[(1, 3)] == 3.0 and len(got) == 6


@pytest.mark.parametrize("few, bins", [(1, 2), (3, 16)])
def test_narrowed_brackets_give_the_same_quantiles(spark, monkeypatch, few, bins):
    """Brackets narrowed to the end: ties, outliers, infinities' neighbours and one-value groups."""
    import numpy as np

    from fieldmark.operators import posterior

    monkeypatch.setattr(posterior, "FEW", few)
    monkeypatch.setattr(posterior, "BINS", bins)
    r = np.random.default_rng(1)
    groups = {"even": r.normal(size=300), "ties": r.integers(0, 4, 200) * 1.0, "far": np.concatenate((r.normal(size=150), [1e300, -1e300, 1e308, -1e308])), "same": np.full(120, 2.5)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "parameter string, value double")
    got = {x.parameter: x.quantiles for x in posterior.exact_quantiles(df, ["parameter"], accuracy=50).collect()}
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, posterior.QUANTILES), rel=1e-12, abs=1e-12), k
