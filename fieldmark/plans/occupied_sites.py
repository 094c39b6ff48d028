"""How many sites are occupied: the whole distribution, not only its mean.

Given each site's probability, the number of occupied sites of a species and year is
Poisson-binomial.  Sites are dealt into blocks; a block's distribution is
a chain of two-point convolutions, and distributions of blocks are convolved
sixteen at a time until one is left, so no task holds all sites of a group.  A
distribution is kept as its support above a negligible mass, some ten
standard deviations either way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.session import settle

#: Sites of a block, distributions that are convolved in one go, and the mass below which a tail is left out.
BLOCK, FAN, TAIL = 512, 16, 1e-18

_DOUBLES = pa.list_(pa.float64())


def trimmed(first: int, masses: np.ndarray) -> tuple[int, np.ndarray]:
    """(first count, masses) without the ends that hold no more than TAIL."""
    held = np.flatnonzero(masses > TAIL)
    return first + int(held[0]), masses[held[0] : held[-1] + 1]


def of_sites(probabilities: Sequence[float]) -> tuple[int, np.ndarray]:
    """The distribution of a sum of independent yes or no sites."""
    masses = np.ones(1)
    for p in probabilities:
        masses = np.append(masses, 0.0) * (1 - p) + np.insert(masses, 0, 0.0) * p
    return trimmed(0, masses)


def convolved(parts: Sequence[tuple[int, Sequence[float]]]) -> tuple[int, np.ndarray]:
    """The distribution of a sum of independent counts.

    Products are summed directly: a transform would blur tails that quantiles need.
    """
    first, masses = 0, np.ones(1)
    for start, part in parts:
        first, masses = trimmed(first + start, np.convolve(masses, np.asarray(part)))
    return first, masses


def quantile(first: int, masses: np.ndarray, q: float) -> int:
    """The least count whose cumulative mass reaches ``q``."""
    upto = np.cumsum(masses)
    return first + int(min(np.searchsorted(upto, q - 1e-12), len(upto) - 1))


def _folded(groups: DataFrame, keys: Sequence[str], sites: bool) -> DataFrame:
    """(keys, first, masses) from ``parts``: probabilities of sites, or distributions."""
    plain = ", ".join(f"`{k}` {t}" for k, t in groups.dtypes if k in keys)
    names = [k for k, _ in groups.dtypes if k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [of_sites(p) if sites else convolved([(x["first"], x["masses"]) for x in p]) for p in batch.column("parts").to_pylist()]
            values = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1].tolist() for o in out], _DOUBLES)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *values], names=[*names, "first", "masses"])

    return groups.select(*names, "parts").mapInArrow(run, f"{plain}, first long, masses array<double>")


def occupied_distribution(probabilities: DataFrame, keys: Sequence[str] = ("species", "year"), site: str = "site", z: str = "z_prob", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(keys, n_sites, first, masses): the distribution of the number of occupied sites per group.

    ``masses`` starts at the count ``first``.  Sites without a probability are not counted.
    """
    keys = list(keys)
    given = probabilities.where(F.col(z).isNotNull()).select(*keys, site, F.col(z).cast("double").alias("__z"))
    sizes = given.groupBy(*keys).agg(F.count("*").alias("n_sites"))
    largest = sizes.agg(F.max("n_sites")).first()[0] or 0
    blocks = max(1, -(-largest // block))
    dealt = given.withColumn("__block", F.pmod(F.xxhash64(site, F.lit("block")), F.lit(blocks)))
    packed = dealt.groupBy(*keys, "__block").agg(F.sort_array(F.collect_list("__z")).alias("parts"))  # about ``block`` of them
    rows = _folded(packed, [*keys, "__block"], sites=True)
    while True:
        blocks = -(-blocks // fan)
        part = F.array_sort(F.collect_list(F.struct("first", "masses")))
        groups = settle(rows).withColumn("__block", F.floor(F.col("__block") / fan)).groupBy(*keys, "__block").agg(part.alias("parts"))
        rows = _folded(groups, [*keys, "__block"], sites=False)
        if blocks == 1:
            return rows.drop("__block").join(sizes, keys).select(*keys, "n_sites", "first", "masses")


def occupied_bounds(distribution: DataFrame, keys: Sequence[str] = ("species", "year"), level: float = 0.95) -> DataFrame:
    """Mean, bounds and spread of the number of occupied sites, as counts and in percent of the sites."""
    keys = list(keys)
    plain = ", ".join(f"`{k}` {t}" for k, t in distribution.dtypes if k in keys)
    tail = (1 - level) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, masses in zip(batch.column("first").to_pylist(), batch.column("masses").to_pylist()):
                m, counts = np.array(masses), first + np.arange(len(masses))
                mean = float((m * counts).sum())
                out.append((mean, float(np.sqrt((m * (counts - mean) ** 2).sum())), quantile(first, m, tail), quantile(first, m, 1 - tail)))
            values = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), batch.column("n_sites"), *values], names=[*keys, "n_sites", "mean", "sd", "lower", "upper"])

    found = distribution.select(*keys, "n_sites", "first", "masses").mapInArrow(run, f"{plain}, n_sites long, mean double, sd double, lower long, upper long")
    percent = lambda c: F.col(c) * 100.0 / F.col("n_sites")
    return found.withColumns({f"{c}_percent": percent(c) for c in ("mean", "lower", "upper")})
