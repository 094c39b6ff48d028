"""Blocks of histories against the chain row by row."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmark.plans import history_blocks as B
from fieldmark.plans import occupancy as O

GROUPED = "species string, h array<struct<t:int,k:int>>, w long"
N = 5


def grouped(spark, seed=3, each=40):
    r = random.Random(seed)
    rows = [(s, [(t := r.randrange(0, 4), r.randrange(0, t + 1) * r.randrange(0, 2)) for _ in range(N)], r.randrange(1, 6)) for s in "abc" for _ in range(each)]
    return spark.createDataFrame(rows, GROUPED)


def parameters(spark, seed=5):
    r = random.Random(seed)
    rates = lambda: [r.uniform(0.05, 0.95) for _ in range(N)]
    return spark.createDataFrame([(s, r.random(), rates(), rates(), rates()) for s in "abc"], "species string, psi1 double, phi array<double>, gamma array<double>, p array<double>")


def row_by_row(df, parameters):
    """The sums from the columns of forward and backward, a row per history and year."""
    rows = O.chained(df.join(parameters, "species").withColumn("e", O.emissions()), N)
    rows = rows.select("species", "w", "h", F.col("fwd")["ll"].alias("ll"), F.posexplode_outer("bwd").alias("i", "b"))
    s, w = F.col("b")["s"], F.col("w")
    t, k = F.get("h", F.col("i"))["t"], F.get("h", F.col("i"))["k"]
    moved = F.col("b")["x11"].isNotNull()
    parts = {
        "n": w, "s": w * s, "sk": w * s * k, "st": w * s * t, "x11": w * F.col("b")["x11"], "x01": w * F.col("b")["x01"],
        "from1": F.when(moved, w * s), "from0": F.when(moved, w * (1 - s)), "ll": F.when(F.col("i") == 0, w * F.col("ll")),
    }
    return {(r.species, r.i): [r[c] for c in B.SUMS] for r in rows.groupBy("species", "i").agg(*[F.sum(x).alias(c) for c, x in parts.items()]).collect()}


def sums(df):
    return {(r.species, r.i): [r[c] for c in B.SUMS] for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for key, values in want.items():
        for a, b in zip(got[key], values):
            assert a is None and b is None or a == pytest.approx(b, rel=1e-10, abs=1e-10), key


def test_sums_of_blocks_match_the_chain_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 16)
    df, params = grouped(spark), parameters(spark)
    blocks = B.history_blocks(df, N)
    assert 6 <= blocks.count() < 30
    same(sums(O.em_sums(blocks, params, N)), row_by_row(df, params))


def test_what_follows_from_a_missing_count_is_left_out(spark):
    odd = [("a", [(1, 0)] * 2, 2), ("a", None, 3), ("b", [(2, 1), (None, 0), (1, 0), (1, 1), (0, 0)], 4), ("c", [(1, 0)], 3), ("d", [(1, 1)] * N, 1), (None, [(1, 1)] * N, 1)]
    whole, params = grouped(spark, each=3).where("species = 'a'"), parameters(spark)
    df = whole.unionByName(spark.createDataFrame(odd, GROUPED))
    got = sums(O.em_sums(df, params, N))
    want = {key: [v[0] + 5, *v[1:]] for key, v in row_by_row(whole, params).items()}
    same({key: v for key, v in got.items() if key[0] == "a"}, want)
    assert got["c", 0] == [3.0] + [None] * 8 and got["b", 3][1] == 4.0 and ("d", 0) not in got
    assert B.history_blocks(df.limit(0), N).count() == 0


def test_more_different_counts_than_two_bytes_hold():
    h = pa.array([[{"t": i, "k": 0}] * 2 for i in range(70_000)])
    t, k, codes, w = B.packed(h, pa.array([1] * 70_000), 2)
    assert codes.dtype == np.uint32 and t[codes[1]].tolist() == list(range(70_000))
    assert not k.any() and w.sum() == 70_000


def test_a_pass_sends_blocks_not_histories(spark):
    """A pass reads a row per block: neither years nor the shifted copies of a score are rows of their own."""
    blocks = B.history_blocks(grouped(spark), N)
    assert blocks.count() <= 3
    thetas = spark.createDataFrame([(s, [0.1, 0.2, -0.3, 0.4]) for s in "abc"], "species string, theta array<double>")
    shifted = thetas.selectExpr("named_struct('__of', species, 'at', 1, 'sign', 1) as species", "theta")
    for df in (O._em_step(blocks, thetas, N, True), O._em_score(blocks, shifted, N, True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
