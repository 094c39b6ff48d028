"""Dynamic and single-season occupancy models as DataFrame jobs.

A history is one row per species and site with an array of yearly structs
``(t, k)``: replicates and detections.  The two-state chain runs inside the
row; sums over sites are hash aggregates by species.  The fits walk blocks of
histories at once (:mod:`history_blocks`).  Years are few (a survey's
length), so a history is short whatever the number of visits behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.columns import ratio
from fieldmark.operators.pruning import visit_days
from fieldmark.operators.replicates import site_day_species, species_shares
from fieldmark.plans import fitting
from fieldmark.plans.history_blocks import chain_sums, history_blocks
from fieldmark.plans.scores import per_species
from fieldmark.session import BROADCAST_ROWS, checked_broadcast, settle, spread

EDGE = 1e-6


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), c))


def _clamped(c: str) -> str:
    """The same in SQL."""
    return f"greatest({EDGE!r}D, least({1 - EDGE!r}D, {c}))"


# -- trajectories -------------------------------------------------------------


def psi_trajectory(parameters: DataFrame, years: range, n_sites: Column | None = None) -> DataFrame:
    """psi by year from psi1, phi, gamma per species (and per draw if given).

    Adds the expected number of occupied sites, the growth rate and the
    turnover.  The recursion folds over the years inside each row.
    """
    keys = [c for c in parameters.columns if c not in ("psi1", "phi", "gamma")]

    def step(acc: Column, _: Column) -> Column:
        psi = F.element_at(acc, -1)
        return F.concat(acc, F.array(psi * F.col("phi") + (1 - psi) * F.col("gamma")))

    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(years) - 1)) if len(years) > 1 else F.array().cast("array<int>"),
        F.array(F.col("psi1").cast("double")),
        step,
    )
    before = F.when(F.col("i") > 0, F.get("path", F.col("i") - 1))
    rows = (
        parameters.withColumn("path", path)
        .select("*", F.posexplode_outer("path").alias("i", "psi"))
        .withColumn("before", before)
    )
    return rows.select(
        *keys,
        (F.col("i") + F.lit(years.start)).cast("int").alias("year"),
        "psi",
        *([] if n_sites is None else [(n_sites * F.col("psi")).alias("n_occ")]),
        F.try_divide("psi", "before").alias("growth"),
        ratio((1 - F.col("before")) * F.col("gamma"), "psi").alias("turnover"),
    )


def growth_and_turnover(psi: DataFrame, gamma: str = "gamma") -> DataFrame:
    """The same two rates from a table of psi by species and year."""
    w = Window.partitionBy("species").orderBy("year")
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("psi").over(w))
    return psi.withColumn("__before", before).withColumns(
        {"growth": F.try_divide("psi", "__before"), "turnover": ratio((1 - F.col("__before")) * F.col(gamma), "psi")}
    ).drop("__before")


def occupied_share(states: DataFrame, n_sites: Column, z: str = "z") -> DataFrame:
    """Occupied sites and their percentage by species and year."""
    return states.groupBy("species", "year").agg(F.sum(z).alias("n_occ")).withColumn(
        "percent", F.try_divide(F.col("n_occ"), n_sites) * 100
    )


# -- histories ----------------------------------------------------------------


def site_histories(
    checklists: DataFrame,
    detections: DataFrame,
    species: DataFrame,
    years: range,
    site: str = "site",
    event: str = "event_id",
) -> DataFrame:
    """(site, species, h): ``h`` has one struct (t, k) per year of ``years``.

    Both sides are first reduced to counts of distinct visit days and then
    partitioned by site once, which serves the packing and the join.  The
    species are expanded after it, so undetected species cost no shuffle.
    Visits outside ``years`` take no part; ``visits_outside`` counts them.
    """
    lists = checklists.where(F.col("year").between(years.start, years.stop - 1))
    # a sum per year, and not a collected map: such groups are hashed and not sorted
    by_year = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("year") == y, F.col(c))), F.lit(0)).cast("int") for y in years])
    days = visit_days(lists, site).groupBy(site, "year").agg(F.count("*").alias("t"))
    effort = spread(days, site).groupBy(site).agg(by_year("t").alias("__t"))
    found = (
        site_day_species(lists, detections, site, event)
        .where(F.col("species").isNotNull())
        .groupBy(site, "species", "year")
        .agg(F.count("*").alias("k"))
    )
    hits = (
        spread(found, site)
        .groupBy(site, "species")
        .agg(by_year("k").alias("k"))
        .groupBy(site)
        .agg(F.collect_list(F.struct("species", "k")).alias("__hits"))
    )
    known = F.coalesce("__hits", F.array().cast("array<struct<species:string,k:array<int>>>"))
    dealt = species_shares(effort.join(hits, site, "left").withColumn("__hits", known), species)
    sites = dealt.select(
        site,
        "__t",
        F.filter("__hits", lambda x: F.array_contains("__names", x["species"])).alias("__hits"),
        F.array_except("__names", F.transform("__hits", lambda x: x["species"])).alias("__unseen"),
    )
    zeros = F.array_repeat(F.lit(0), len(years))
    blank = F.transform("__unseen", lambda s: F.struct(s.alias("species"), zeros.alias("k")))
    rows = sites.select(F.col(site).alias("__site"), F.col("__t").alias("t"), F.inline(F.concat("__hits", blank)))
    return rows.select(F.col("__site").alias(site), "species", F.arrays_zip("t", "k").alias("h"))


def visits_outside(checklists: DataFrame, years: range) -> DataFrame:
    """Lists by year (or without one) that histories over ``years`` leave out."""
    outside = F.col("year").isNull() | ~F.col("year").between(years.start, years.stop - 1)
    return checklists.where(outside).groupBy("year").agg(F.count("*").alias("n_lists"))


def grouped_histories(histories: DataFrame) -> DataFrame:
    """Equal histories of a species merged into one weighted row (exact)."""
    return histories.groupBy("species", "h").agg(F.count("*").alias("w"))


# -- the chain ----------------------------------------------------------------


def forward(n: int) -> Column:
    """Struct of arrays ``pred``, ``filt`` and the log-likelihood ``ll``.

    Reads ``psi1``, the arrays ``phi`` and ``gamma`` (entry i is the step from
    year i to i + 1) and ``e``, one struct per year: ``seen`` (any detection),
    ``log_hit`` (log-probability of the year's record at an occupied site, 0
    without a visit) and its exponential ``hit``.  A year with a detection is
    occupied for sure; otherwise ``pred * hit + 1 - pred`` is the probability
    of seeing nothing, which cannot underflow.
    """
    empty = F.array().cast("array<double>")
    start = F.struct(
        F.col("psi1").cast("double").alias("next"), empty.alias("pred"), empty.alias("filt"), F.lit(0.0).alias("ll")
    )

    def step(acc: Column, i: Column) -> Column:
        pred, e = acc["next"], F.get("e", i)
        quiet = pred * e["hit"] + 1 - pred
        filt = F.when(e["seen"], F.lit(1.0)).otherwise(pred * e["hit"] / quiet)
        ll = F.when(e["seen"], F.ln(pred) + e["log_hit"]).otherwise(F.ln(quiet))
        phi, gamma = F.coalesce(F.get("phi", i), F.lit(0.0)), F.coalesce(F.get("gamma", i), F.lit(0.0))
        return F.struct(
            (gamma + filt * (phi - gamma)).alias("next"),
            F.concat(acc["pred"], F.array(pred)).alias("pred"),
            F.concat(acc["filt"], F.array(filt)).alias("filt"),
            (acc["ll"] + ll).alias("ll"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)


def backward(n: int) -> Column:
    """Array of structs per year from ``fwd``: smoothed ``s`` and the pair terms ``x11``, ``x01``."""
    pair = "array<struct<s:double,x11:double,x01:double>>"
    none = F.lit(None).cast("double")
    last = F.array(
        F.struct(F.get(F.col("fwd")["filt"], F.lit(n - 1)).alias("s"), none.alias("x11"), none.alias("x01"))
    ).cast(pair)
    if n == 1:
        return last

    def step(acc: Column, i: Column) -> Column:
        after = F.get(acc, F.lit(0))["s"]
        filt, pred = F.get(F.col("fwd")["filt"], i), F.get(F.col("fwd")["pred"], i + 1)
        phi, gamma = F.get("phi", i), F.get("gamma", i)
        stay = filt * phi * after / pred
        leave = filt * (1 - phi) * (1 - after) / (1 - pred)
        arrive = (1 - filt) * gamma * after / pred
        here = F.struct((stay + leave).alias("s"), stay.alias("x11"), arrive.alias("x01"))
        return F.concat(F.array(here), acc).cast(pair)

    return F.aggregate(F.sequence(F.lit(n - 2), F.lit(0), F.lit(-1)), last, step)


def emissions() -> Column:
    """``e`` from the counts ``h`` and the detection probabilities ``p`` by year."""
    logs = F.transform(
        "h",
        lambda x, i: F.struct(
            (x["k"] > 0).alias("seen"),
            (x["k"] * F.ln(F.get("p", i)) + (x["t"] - x["k"]) * F.ln(1 - F.get("p", i))).alias("log_hit"),
        ),
    )
    return F.transform(logs, lambda x: F.struct(x["seen"].alias("seen"), x["log_hit"].alias("log_hit"), F.exp(x["log_hit"]).alias("hit")))


def visit_emissions(scored: DataFrame, site: str = "site", p: str = "p", y: str = "y") -> DataFrame:
    """Yearly evidence from visits with their own detection probability.

    (species, site, year) with ``seen`` and ``log_hit``, the sum of
    ``y ln p + (1 - y) ln(1 - p)`` over the year's visits.
    """
    term = F.when(F.col(y) == 1, F.ln(p)).otherwise(F.ln(1 - F.col(p)))
    return scored.groupBy("species", site, "year").agg((F.max(y) == 1).alias("seen"), F.sum(term).alias("log_hit"))


def pack_emissions(yearly: DataFrame, years: range, site: str = "site") -> DataFrame:
    """``e`` per (species, site) over all ``years``; a year without visits says nothing."""
    index = (F.col("year") - F.lit(years.start)).cast("int")
    packed = yearly.groupBy("species", site).agg(
        F.map_from_entries(F.collect_list(F.struct(index, F.struct("seen", "log_hit")))).alias("__y")
    )
    at = lambda i: F.try_element_at("__y", i)
    e = F.transform(
        F.sequence(F.lit(0), F.lit(len(years) - 1)),
        lambda i: F.struct(
            F.coalesce(at(i)["seen"], F.lit(False)).alias("seen"),
            F.coalesce(at(i)["log_hit"], F.lit(0.0)).alias("log_hit"),
            F.exp(F.coalesce(at(i)["log_hit"], F.lit(0.0))).alias("hit"),
        ),
    )
    return packed.select("species", site, e.alias("e"))


def constant_parameters(table: DataFrame, n: int) -> DataFrame:
    """psi1, phi, gamma, p per species -> arrays over the years."""
    repeat = lambda c: F.array_repeat(F.col(c).cast("double"), n)
    return table.select(
        "species", F.col("psi1").cast("double").alias("psi1"), *[repeat(c).alias(c) for c in ("phi", "gamma", "p")]
    )


def chained(rows: DataFrame, n: int, smooth: bool = True) -> DataFrame:
    """Add ``fwd`` (and ``bwd``) to rows that hold ``e``, ``psi1``, ``phi``, ``gamma``."""
    out = rows.withColumn("fwd", forward(n))
    return out.withColumn("bwd", backward(n)) if smooth else out


def history_loglik(histories: DataFrame, parameters: DataFrame, n: int, site: str = "site") -> DataFrame:
    """Log-likelihood and filtered last-year occupancy per species and site."""
    rows = histories.join(checked_broadcast(parameters), "species").withColumn("e", emissions())
    return loglik_of(rows, n, site)


def loglik_of(rows: DataFrame, n: int, site: str = "site") -> DataFrame:
    """The same from rows that hold ``e`` and their own (site-specific) ``psi1``, ``phi``, ``gamma``."""
    return chained(rows, n, smooth=False).select(
        site, "species", F.col("fwd")["ll"].alias("loglik"), F.element_at(F.col("fwd")["filt"], -1).alias("filtered")
    )


def smoothed_occupancy(histories: DataFrame, parameters: DataFrame, years: range, site: str = "site") -> DataFrame:
    """P(z = 1 given all data) per species, site and year."""
    rows = histories.join(checked_broadcast(parameters), "species").withColumn("e", emissions())
    return chained(rows, len(years)).select(site, "species", F.posexplode_outer("bwd").alias("__i", "__s")).select(
        site, "species", (F.col("__i") + years.start).alias("year"), F.col("__s")["s"].alias("z_prob")
    )


# -- expectation-maximisation -------------------------------------------------


def em_sums(grouped: DataFrame, parameters: DataFrame, n: int, few: bool | None = None) -> DataFrame:
    """Expected sufficient statistics by species and year.

    ``grouped`` are weighted histories or their blocks (:func:`history_blocks`), which callers with several
    passes make once.  ``parameters`` is settled already; ``few`` says whether it has few enough rows for a broadcast, else they are counted.
    Sums over the histories of a block are made inside the task and combined for the blocks it has at hand, so
    a hot species sends few rows per year and task.
    """
    blocks = grouped if "codes" in grouped.columns else history_blocks(grouped, n)
    table = checked_broadcast(parameters, settled=True) if few is None else F.broadcast(parameters) if few else parameters
    return chain_sums(blocks, table, n)


def em_maximise(sums: DataFrame, n: int, by_year: bool) -> DataFrame:
    """New parameters from the expected statistics; ``loglik`` is that of the old ones."""
    parts = {"phi": ("x11", "from1"), "gamma": ("x01", "from0"), "p": ("sk", "st")}
    psi1 = F.expr(f"{_clamped('max(case when i = 0 then s / n end)')} as psi1")
    loglik = F.expr("sum(ll) as loglik")
    if not by_year:
        # in SQL, as a fit makes this plan anew in every pass
        pooled = [f"array_repeat({_clamped(f'coalesce(try_divide(sum({a}), sum({b})), 0.5D)')}, {n}) as {c}" for c, (a, b) in parts.items()]
        return sums.groupBy("species").agg(psi1, *map(F.expr, pooled), loglik)
    yearly = sums.groupBy("species").agg(
        psi1,
        *[
            F.transform(
                F.array_sort(F.collect_list(F.struct("i", F.try_divide(F.col(a), F.col(b)).alias("v")))),
                lambda x: clamp(F.coalesce(x["v"], F.lit(0.5))),
            ).alias(c)
            for c, (a, b) in parts.items()
        ],
        loglik,
    )
    return yearly.select("species", "psi1", "phi", "gamma", "p", "loglik")


def start_parameters(species: DataFrame, n: int, psi1: float = 0.5, phi: float = 0.8, gamma: float = 0.2, p: float = 0.3) -> DataFrame:
    rows = species.select("species").distinct().withColumns(
        {"psi1": F.lit(psi1), "phi": F.lit(phi), "gamma": F.lit(gamma), "p": F.lit(p)}
    )
    return constant_parameters(rows, n).withColumn("loglik", F.lit(None).cast("double"))


def fit_dynamic(
    histories: DataFrame,
    n: int,
    start: DataFrame | None = None,
    iterations: int = 500,
    tolerance: float = 1e-8,
    by_year: bool = False,
) -> DataFrame:
    """Maximum likelihood (the posterior mode under uniform priors) by EM.

    Histories are merged and packed into blocks once.  Each iteration is one job over
    those of the species that still move; its result, one row per species, is
    settled in the shared folder, so the plan does not grow and only the number of
    species left reaches the driver.  A species stops when its own
    log-likelihood moves by no more than ``tolerance`` of itself.  Every row
    says how many ``iterations`` it took and whether it ``converged``; a species
    that still moves after ``iterations`` is returned as not converged.
    ``loglik`` belongs to the returned parameters.
    """
    grouped = history_blocks(settle(grouped_histories(histories)), n)
    names = ["species", "psi1", "phi", "gamma", "p"]
    first = (start if start is not None else start_parameters(grouped, n)).select(*names)
    none = F.lit(None).cast("double")
    state = settle(first.withColumns({"loglik": none, "iterations": F.lit(0), "converged": F.lit(False), "done": F.lit(False)}))
    for k in range(iterations + 1):
        moving = settle(state.where("not done"))
        if moving.isEmpty():
            break
        new = em_maximise(em_sums(grouped, moving.select(*names), n), n, by_year)
        stepped = new.select("species", F.struct(*names[1:], "loglik").alias("new"))
        ended = F.coalesce(F.abs(F.col("new.loglik") - F.col("loglik")) <= F.lit(tolerance) * F.abs("loglik"), F.lit(False))
        stay = F.lit(True) if k == iterations else F.col("ended")
        after = (
            moving.join(stepped, "species")
            .withColumn("ended", ended)
            .select(
                "species",
                *[F.when(stay, F.col(c)).otherwise(F.col(f"new.{c}")).alias(c) for c in names[1:]],
                F.col("new.loglik").alias("loglik"),
                F.when(stay, F.col("iterations")).otherwise(F.col("iterations") + 1).alias("iterations"),
                F.col("ended").alias("converged"),
                stay.alias("done"),
            )
        )
        state = settle(state.where("done").unionByName(after))
    return state.drop("done")


_RATES = ("psi1", "phi", "gamma", "p")


def _from_theta(thetas: DataFrame, n: int) -> DataFrame:
    """Logits of psi1, phi, gamma, p -> the parameter table of the chain."""
    rates = thetas.selectExpr("species", f"transform(theta, x -> {_clamped('1 / (1 + exp(-x))')}) as r")
    return rates.selectExpr("species", "get(r, 0) as psi1", *[f"array_repeat(get(r, {i}), {n}) as {c}" for i, c in enumerate(_RATES) if i])


def _em_step(grouped: DataFrame, thetas: DataFrame, n: int, few: bool | None = None) -> DataFrame:
    new = em_maximise(em_sums(grouped, _from_theta(thetas, n), n, few), n, by_year=False)
    rates = ", ".join(["psi1", *(f"get({c}, 0)" for c in _RATES[1:])])
    return new.selectExpr("species", "loglik as objective", f"transform(array({rates}), x -> ln(x / (1 - x))) as next")


def _em_score(grouped: DataFrame, shifted: DataFrame, n: int, few: bool | None = None) -> DataFrame:
    """Gradient of the log-likelihood in the logits, from the same sums (Fisher's identity); the rows' species are structs with a shift."""
    parameters = _from_theta(shifted, n)
    first = [f"sum(case when i = 0 then {c} end) as {c}" for c in ("s", "n")]
    rest = [f"sum({c}) as {c}" for c in ("x11", "from1", "x01", "from0", "sk", "st")]
    sums = em_sums(grouped, parameters, n, few).groupBy("species").agg(*map(F.expr, first + rest))
    pairs = (("s", "n", "psi1"), ("x11", "from1", "get(phi, 0)"), ("x01", "from0", "get(gamma, 0)"), ("sk", "st", "get(p, 0)"))
    slopes = ", ".join(f"coalesce({a}, 0D) - coalesce({b}, 0D) * {rate}" for a, b, rate in pairs)
    return sums.join(F.broadcast(parameters) if few else parameters, "species").selectExpr("species", f"array({slopes}) as score")


def fit_dynamic_with_errors(histories: DataFrame, n: int, iterations: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """The fit of :func:`fit_dynamic` with constant rates, by accelerated EM and Newton steps on the logits, with standard errors.

    (species, psi1, phi, gamma, p, loglik, iterations, converged, errors): ``iterations`` counts jobs
    over the histories, ``errors`` are those of the four logits in that order, from the
    observed information, null where a rate lies at its bound.  A species has
    converged when an EM step moves no logit by more than ``tolerance`` or no longer raises the log-likelihood.
    """
    grouped = history_blocks(settle(grouped_histories(histories)), n)
    start = start_parameters(grouped, n).select("species", F.expr("array(psi1, phi[0], gamma[0], p[0])").alias("r"))
    thetas = start.select("species", F.transform("r", lambda x: F.ln(x / (1 - x))).alias("theta"))
    rows = thetas.count()
    step = lambda t: _em_step(grouped, t, n, rows <= BROADCAST_ROWS)
    score = lambda t: _em_score(grouped, t, n, 2 * len(_RATES) * rows <= BROADCAST_ROWS)
    full = fitting.with_errors(score, fitting.finished(step, score, thetas, iterations=iterations, tolerance=tolerance))
    rates = [clamp(1 / (1 + F.exp(-F.get("theta", F.lit(i))))).alias(c) for i, c in enumerate(_RATES)]
    return full.select("species", *rates, F.col("objective").alias("loglik"), "iterations", "converged", "errors")


def season_counts(checklists: DataFrame, detections: DataFrame, species: DataFrame, site: str = "site", event: str = "event_id") -> DataFrame:
    """(species, k, t, w): sites by detections and replicates in one season.

    Sites without a detection follow from the totals: sites with t replicates
    minus those where the species was seen.
    """
    reps = settle(visit_days(checklists, site).groupBy(site).agg(F.count("*").cast("int").alias("t")))
    hits = settle(
        site_day_species(checklists, detections, site, event)
        .groupBy(site, "species")
        .agg(F.count("*").cast("int").alias("k"))
        .join(reps, site)
        .groupBy("species", "k", "t")
        .agg(F.count("*").alias("w"))
    )
    totals = per_species(reps.groupBy("t").agg(F.count("*").alias("__all")), species.select("species").distinct())
    met = hits.groupBy("species", "t").agg(F.sum("w").alias("__met"))
    unseen = (
        totals.join(met, ["species", "t"], "left")
        .select("species", F.lit(0).alias("k"), "t", (F.col("__all") - F.coalesce("__met", F.lit(0))).alias("w"))
        .where("w > 0")
    )
    return hits.unionByName(unseen)


def fit_single_season(
    counts: DataFrame, iterations: int = 500, psi: float = 0.5, p: float = 0.5, tolerance: float = 1e-8
) -> DataFrame:
    """Constant psi and p per species, and the expected number of occupied sites.

    The counts of a species are at most one per (k, t) pair of a season's
    days, so they fit in one array and all iterations fold inside the row.  A
    species stops when neither parameter moves by more than ``tolerance``;
    ``converged`` says whether it did within ``iterations``.
    """
    packed = counts.groupBy("species").agg(
        F.array_sort(
            F.collect_list(F.struct(*[F.col(n).cast("double").alias(n) for n in ("k", "t", "w")]))
        ).alias("c")
    )

    def occupied(c: Column, psi: Column, p: Column) -> Column:
        quiet = psi * F.exp(c["t"] * F.ln(1 - p))
        return F.when(c["k"] > 0, F.lit(1.0)).otherwise(quiet / (quiet + 1 - psi))

    def iterate(acc: Column, _: Column) -> Column:
        sums = F.aggregate(
            "c",
            F.struct(*[F.lit(0.0).alias(n) for n in ("n", "s", "sk", "st")]),
            lambda a, c: F.transform(
                F.array(occupied(c, acc["psi"], acc["p"])),
                lambda e: F.struct(
                    (a["n"] + c["w"]).alias("n"),
                    (a["s"] + c["w"] * e).alias("s"),
                    (a["sk"] + c["w"] * e * c["k"]).alias("sk"),
                    (a["st"] + c["w"] * e * c["t"]).alias("st"),
                ),
            )[0],
        )
        moved = lambda v: F.greatest(F.abs(v["psi"] - acc["psi"]), F.abs(v["p"] - acc["p"]))
        new = F.transform(
            F.array(sums),
            lambda x: F.struct(clamp(x["s"] / x["n"]).alias("psi"), clamp(x["sk"] / x["st"]).alias("p")),
        )
        step = F.transform(new, lambda v: F.struct(v["psi"].alias("psi"), v["p"].alias("p"), (moved(v) <= tolerance).alias("ended")))[0]
        return F.when(acc["ended"], acc).otherwise(step)

    start = F.struct(F.lit(psi).cast("double").alias("psi"), F.lit(p).cast("double").alias("p"), F.lit(False).alias("ended"))
    fitted = packed.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, iterate))
    total = F.aggregate(
        "c", F.lit(0.0), lambda a, c: a + c["w"] * occupied(c, F.col("f")["psi"], F.col("f")["p"])
    )
    return fitted.select(
        "species",
        F.col("f")["psi"].alias("psi"),
        F.col("f")["p"].alias("p"),
        total.alias("n_occ"),
        F.col("f")["ended"].alias("converged"),
    )


# -- trends -------------------------------------------------------------------


def species_trend(psi: DataFrame, value: str = "psi", threshold: float = 2.0) -> DataFrame:
    """Least-squares slope of a yearly series per species and its class.

    The class follows from the slope's t-ratio against ``threshold``.
    """
    fit = psi.groupBy("species").agg(
        F.count(value).alias("n"),
        F.regr_slope(F.col(value), F.col("year").cast("double")).alias("slope"),
        F.regr_sxx(F.col(value), F.col("year").cast("double")).alias("sxx"),
        F.regr_syy(F.col(value), F.col("year").cast("double")).alias("syy"),
    )
    residual = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    error = F.sqrt(F.try_divide(F.try_divide(residual, F.col("n") - 2), F.col("sxx")))
    label = (
        F.when(F.col("t_ratio") > threshold, "increasing").when(F.col("t_ratio") < -threshold, "declining").otherwise("stable")
    )
    return (
        fit.withColumn("t_ratio", F.try_divide(F.col("slope"), F.when(F.col("n") > 2, error)))
        .withColumn("trend", label)
        .select("species", "n", "slope", "t_ratio", "trend")
    )
