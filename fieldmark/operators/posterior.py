"""Posterior draws: long tables, summaries, convergence, histograms, densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark import fixed_values as V
from fieldmark.operators.numbering import grouped_row_number
from fieldmark.operators.relational import null_safe_join
from fieldmark.session import BROADCAST_ROWS, checked_broadcast, settle

QUANTILES = (0.025, 0.25, 0.5, 0.75, 0.975)
#: Bins of a histogram that narrows the bracket of a quantile, and rows that a bracket may end with.
BINS, FEW = 256, 4_096


def flatten_array(df: DataFrame, array: str, ids: Sequence[str], depth: int = 1, value: str = "value") -> DataFrame:
    """Nested arrays -> long rows with the true indices ``i1, i2, ...`` (from 1)."""
    out, current, names = df.select(*ids, F.col(array).alias("__a")), "__a", []
    for level in range(1, depth + 1):
        name = f"i{level}"
        out = out.select(*ids, *names, F.posexplode(current).alias("__p", "__v")).select(
            *ids, *names, (F.col("__p") + 1).alias(name), F.col("__v").alias("__a")
        )
        names.append(name)
    return out.select(*ids, *names, F.col("__a").alias(value))


def trace_table(draws: DataFrame, draw_id: str = "draw_id") -> DataFrame:
    """(chain, iteration, parameter, value) with iterations numbered in a chain."""
    numbered = grouped_row_number(draws, ["chain", "parameter"], draw_id, "iteration")
    return numbered.select("chain", "iteration", "parameter", "value")


def union_chains(chains: Sequence[DataFrame]) -> DataFrame:
    """Concatenate per-chain draws, labelling chains from 1."""
    out = chains[0].withColumn("chain", F.lit(1))
    for k, c in enumerate(chains[1:], start=2):
        out = out.unionByName(c.withColumn("chain", F.lit(k)))
    return out


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    quantiles: Sequence[float] = QUANTILES,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantiles by linear interpolation: (*keys, n, quantiles array).

    The built-in exact percentile keeps all distinct values of a group in one
    task, so it serves only groups of at most ``accuracy`` rows.  Larger groups
    go through :func:`_bracketed_quantiles`.  The group sizes decide which of
    the two branches are planned.
    """
    keys = list(keys)
    given = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    sizes = settle(given.groupBy(*keys).agg(F.count("*").alias("n")))
    n_groups, n_large = sizes.agg(F.count("*"), F.count_if(F.col("n") > accuracy)).first()
    branches = []
    if n_large < n_groups:
        few = given
        if n_large:
            few = given.join(_hinted(sizes.where(F.col("n") <= accuracy), n_groups - n_large), keys, "left_semi")
        exact = F.percentile("__v", F.array(*[F.lit(float(q)) for q in quantiles]))
        branches.append(few.groupBy(*keys).agg(F.count("*").alias("n"), exact.alias("quantiles")))
    if n_large:
        many = given.join(_hinted(sizes.where(F.col("n") > accuracy), n_large), keys)
        branches.append(_bracketed_quantiles(many, keys, list(quantiles), accuracy, n_large))
    return branches[0].unionByName(branches[1]) if len(branches) == 2 else branches[0]


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _bracketed_quantiles(df: DataFrame, keys: list[str], quantiles: list[float], accuracy: int, n_groups: int) -> DataFrame:
    """Exact quantiles of groups with more than ``accuracy`` rows.

    A mergeable sketch with rank error n / accuracy brackets each quantile; a
    slack of four errors on both sides leaves at least three ranks to spare.
    Then one pass counts the rows below and inside each bracket (about 10 n / accuracy);
    while a bracket holds more than FEW rows it is narrowed by a histogram, so that
    no task ever ranks more than those, whatever the size of the group.
    """
    slack = 4.0 / accuracy
    probes = [max(0.0, q - slack) for q in quantiles] + [min(1.0, q + slack) for q in quantiles]
    sketch = df.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.percentile_approx("__v", probes, accuracy).alias("__s"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
    )
    brackets = []
    for i, q in enumerate(quantiles):
        lo = F.col("__min") if q <= slack else F.col("__s")[i]
        hi = F.col("__max") if q >= 1 - slack else F.col("__s")[len(quantiles) + i]
        brackets.append(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), lo.alias("lo"), hi.alias("hi")))
    bracketed = df.drop("n").join(
        _hinted(settle(sketch.select(*keys, "n", F.array(*brackets).alias("__b"))), n_groups), keys
    )
    number = range(len(quantiles))
    part = lambda i: F.col("__b")[i]
    counts = bracketed.groupBy(*keys, "n", "__b").agg(
        F.array(*[F.count_if(F.col("__v") < part(i)["lo"]) for i in number]).alias("__below"),
        F.array(*[F.count_if(F.col("__v").between(part(i)["lo"], part(i)["hi"])) for i in number]).alias("__m"),
    )
    state = counts.select(*keys, "n", F.posexplode("__b").alias("__k", "__p"), "__below", "__m").select(
        *keys, "n", F.col("__p.i").alias("i"), (F.col("__p.q") * (F.col("n") - 1)).alias("__pos"), F.col("__p.lo").alias("__lo"), F.col("__p.hi").alias("__hi"),
        F.get("__below", "__k").alias("__below"), F.get("__m", "__k").alias("__m"), F.lit(None).cast("double").alias("__a"), F.lit(None).cast("double").alias("__z"),
    )
    state = settle(state)
    given = df.select(*keys, "__v")
    while not state.where((F.col("__m") > FEW) & F.col("__a").isNull()).isEmpty():
        state = settle(_refined(given, keys, state, n_groups * len(quantiles)))
    return _picked(given, keys, state, n_groups * len(quantiles))


def _inside(df: DataFrame, keys: list[str], state: DataFrame, rows: int) -> DataFrame:
    """The values of each open bracket."""
    brackets = state.where(F.col("__a").isNull()).select(*keys, "i", "__lo", "__hi")
    packed = _hinted(brackets.groupBy(*keys).agg(F.collect_list(F.struct("i", "__lo", "__hi")).alias("__open")), rows)
    return df.join(packed, keys).select(*keys, "__v", F.inline(F.filter("__open", lambda b: F.col("__v").between(b["__lo"], b["__hi"]))))


def _refined(df: DataFrame, keys: list[str], state: DataFrame, rows: int) -> DataFrame:
    """Every open bracket narrowed to the one of BINS equal bins that holds its rank, from counts that are combined map-side.

    Where the two ranks around a quantile lie in different bins, they are the largest value
    of one and the smallest of the next, and the quantile is known.
    """
    wide = F.col("__hi") - F.col("__lo")
    # half the difference twice over: the whole one of two large doubles may be infinite
    half = (F.col("__v") / 2 - F.col("__lo") / 2) / F.greatest(F.col("__hi") / 2 - F.col("__lo") / 2, F.lit(5e-324))
    bin_of = F.when(wide > 0, F.least(F.lit(BINS - 1), F.floor(half * BINS))).otherwise(0).cast("int")
    cells = _inside(df, keys, state, rows).groupBy(*keys, "i", bin_of.alias("__bin")).agg(F.count("*").alias("c"), F.min("__v").alias("v0"), F.max("__v").alias("v1"))
    listed = cells.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("__bin", "c", "v0", "v1"))).alias("__cells"))  # at most BINS
    zero = F.lit(0).cast("long")
    ends = F.aggregate("__cells", F.array().cast("array<bigint>"), lambda a, c: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), zero) + c["c"])))
    found = state.join(listed, [*keys, "i"], "left").withColumn("__ends", F.transform(ends, lambda e: e + F.col("__below")))
    at = lambda rank: F.size(F.filter("__ends", lambda e: e <= rank))
    placed = found.withColumns({"__l": at(F.floor("__pos")), "__r": at(F.ceil("__pos"))})
    cell = lambda k: F.get("__cells", F.col(k))
    open_, apart = F.col("__a").isNull(), F.col("__l") != F.col("__r")
    before = F.when(F.col("__l") > 0, F.get("__ends", F.col("__l") - 1)).otherwise(F.col("__below"))
    same = cell("__l")["v0"] == cell("__l")["v1"]
    return placed.select(
        *keys, "n", "i", "__pos",
        F.when(open_, cell("__l")["v0"]).otherwise(F.col("__lo")).alias("__lo"), F.when(open_, cell("__l")["v1"]).otherwise(F.col("__hi")).alias("__hi"),
        F.when(open_, before).otherwise(F.col("__below")).alias("__below"), F.when(open_, cell("__l")["c"]).otherwise(F.col("__m")).alias("__m"),
        F.when(open_, F.when(apart | same, cell("__l")["v1"])).otherwise(F.col("__a")).alias("__a"), F.when(open_, F.when(apart | same, cell("__r")["v0"])).otherwise(F.col("__z")).alias("__z"),
    )


def _picked(df: DataFrame, keys: list[str], state: DataFrame, rows: int) -> DataFrame:
    """The quantiles, where a bracket is still open from its few values in order."""
    values = _inside(df, keys, state, rows).groupBy(*keys, "i").agg(F.sort_array(F.collect_list("__v")).alias("__few"))
    held = state.join(values, [*keys, "i"], "left")
    rank = lambda r: F.get("__few", (r - F.col("__below")).cast("int"))
    a, z = F.coalesce("__a", rank(F.floor("__pos"))), F.coalesce("__z", rank(F.ceil("__pos")))
    value = F.when(a.isNull() | z.isNull(), F.raise_error(F.lit("quantile bracket lost its rank"))).otherwise(a + (F.col("__pos") - F.floor("__pos")) * (z - a))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"])
    return held.groupBy(*keys, "n").agg(packed.alias("quantiles"))


def posterior_summary(draws: DataFrame, keys: Sequence[str] = ("parameter",), value: str = "value") -> DataFrame:
    """Mean, sd and the five quantiles by parameter."""
    keys = list(keys)
    moments = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    q = exact_quantiles(draws, keys, value)
    names = ("q2_5", "q25", "q50", "q75", "q97_5")
    return null_safe_join(moments, q, keys).select(
        *keys, "mean", "sd", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)]
    )


def rhat(draws: DataFrame, keys: Sequence[str] = ("parameter",), value: str = "value") -> DataFrame:
    """Potential scale reduction (Gelman and Rubin 1992) from per-chain moments."""
    keys = list(keys)
    chains = draws.groupBy(*keys, "chain").agg(
        F.count(value).alias("__n"), F.avg(value).alias("__m"), F.var_samp(value).alias("__v")
    )
    parts = chains.groupBy(*keys).agg(
        F.avg("__n").alias("__n"), F.avg("__v").alias("__w"), F.var_samp("__m").alias("__b")
    )
    pooled = (F.col("__n") - 1) / F.col("__n") * F.col("__w") + F.col("__b")
    return parts.select(*keys, F.sqrt(F.try_divide(pooled, F.col("__w"))).alias("rhat"))


def converged(rhats: DataFrame, limit: float = V.RHAT_LIMIT) -> DataFrame:
    return rhats.where(F.col("rhat") < limit)


def histogram_density(draws: DataFrame, keys: Sequence[str], width: float, value: str = "value") -> DataFrame:
    """Counts and densities in bins of a fixed width centred on its multiples."""
    return _binned(draws, list(keys), F.lit(width), value)


def histogram_bins(draws: DataFrame, keys: Sequence[str], bins: int = 50, value: str = "value") -> DataFrame:
    """Counts and densities in ``bins`` bins over each group's own range."""
    keys = list(keys)
    ranges = draws.groupBy(*keys).agg(((F.max(value) - F.min(value)) / (bins - 1)).alias("__w"))
    return _binned(null_safe_join(draws, checked_broadcast(ranges), keys), keys, F.col("__w"), value)


def _binned(df: DataFrame, keys: list[str], width: Column, value: str) -> DataFrame:
    # A group without spread has one bin, of width one.
    w = F.when(width > 0, width).otherwise(1.0)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, w.alias("width"), F.floor(F.col(value) / w + 0.5).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    return null_safe_join(counts, totals, keys).select(
        *keys,
        "bin",
        (F.col("bin") * F.col("width")).alias("centre"),
        "n",
        (F.col("n") / (F.col("__total") * F.col("width"))).alias("density"),
    )


def kernel_density(
    draws: DataFrame, keys: Sequence[str], points: int = 512, value: str = "value", cut: float = 3.0
) -> DataFrame:
    """Gaussian kernel density on ``points`` grid points per group.

    Draws are first counted in the ``points`` grid cells, so that whatever the
    number of draws a group is one array of at most ``points`` counts; the
    weights are then summed inside that row.  The bandwidth is the usual rule
    of thumb 0.9 min(sd, IQR / 1.34) n^(-1/5); where that is zero the scale is
    the sd, else the size of the values, else 1, so a group without spread has a
    density too.  The grid reaches ``cut`` bandwidths past the data.
    """
    keys = list(keys)
    given = draws.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    spread = given.groupBy(*keys).agg(
        F.stddev_samp("__v").alias("__sd"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )
    quartiles = exact_quantiles(given, keys, "__v", (0.25, 0.75)).withColumn(
        "__iqr", (F.col("quantiles")[1] - F.col("quantiles")[0]) / 1.34
    )
    positive = lambda c: F.when(c > 0, c)
    narrow = F.coalesce(
        positive(F.when(F.col("__iqr") > 0, F.least("__sd", "__iqr"))),
        positive(F.col("__sd")),
        positive(F.abs("__lo")),
        F.lit(1.0),
    )
    scale = (
        null_safe_join(spread, quartiles, keys)
        .withColumn("__bw", 0.9 * narrow * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .select(
            *keys,
            F.col("n").alias("__n"),
            "__bw",
            (F.col("__lo") - cut * F.col("__bw")).alias("__x0"),
            ((F.col("__hi") - F.col("__lo") + 2 * cut * F.col("__bw")) / (points - 1)).alias("__step"),
        )
    )
    cells = null_safe_join(given, checked_broadcast(scale), keys).groupBy(
        *keys, "__n", "__bw", "__x0", "__step", F.floor((F.col("__v") - F.col("__x0")) / F.col("__step") + 0.5).alias("__k")
    ).agg(F.count("*").alias("__c"))
    packed = cells.groupBy(*keys, "__n", "__bw", "__x0", "__step").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("__k").cast("double").alias("k"), F.col("__c").cast("double").alias("c")))
        ).alias("__cells")
    )
    ratio = F.col("__step") / F.col("__bw")
    height = F.aggregate(
        "__cells",
        F.lit(0.0),
        lambda acc, b: acc + b["c"] * F.exp(-0.5 * F.pow((F.col("__g") - b["k"]) * ratio, F.lit(2.0))),
    ) / (F.col("__n") * F.col("__bw") * math.sqrt(2 * math.pi))
    return packed.withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        *keys,
        F.col("__g").alias("point"),
        (F.col("__x0") + F.col("__g") * F.col("__step")).alias("x"),
        height.alias("density"),
    )
