"""Maximum-likelihood fits of many species side by side: accelerated steps and standard errors.

A fit is a table with one row per species and an array ``theta`` of unbounded
numbers.  Its model is a function from such a table to the objective and the next
``theta`` of an EM step; that function is the only one that reads the survey, in one
job for all species that still move.  Everything here is arithmetic on that small
table, settled after each job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.session import settle

#: (key, theta) -> (key, objective, next): the objective at theta and an EM step from there.
Step = Callable[[DataFrame], DataFrame]
#: (key, theta) -> (key, score): the gradient of the objective at theta.
Score = Callable[[DataFrame], DataFrame]


def leap(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Squared extrapolation from a point, an EM step from it and one more (Varadhan and Roland 2008)."""
    r, v = here - before, after - 2 * here + before
    bend = float(np.linalg.norm(v))
    # a step length under one would fall short of the second EM step
    length = max(1.0, float(np.linalg.norm(r)) / bend) if bend > 0 else 1.0
    return before + 2 * length * r + length * length * v


@dataclass
class Row:
    """Where one species stands: the best point so far, the point under trial, and how that was reached."""

    good: np.ndarray
    best: float | None
    here: np.ndarray
    ahead: np.ndarray
    leaping: bool
    pure: bool
    iterations: int
    converged: bool
    done: bool

    def after(self, objective: float | None, following: np.ndarray | None, tolerance: float, leaps: bool, gain: float = 0.0) -> Row:
        n = self.iterations + 1
        slack = 1e-10 * (1 + abs(self.best or 0.0))
        fine = objective is not None and math.isfinite(objective) and (self.best is None or objective >= self.best - slack) and bool(np.isfinite(following).all())
        if not fine:
            back = self.ahead if self.leaping else (self.good + self.here) / 2
            return Row(self.good, self.best, back, self.ahead, False, self.leaping, n, False, False)
        still = np.abs(following - self.here).max() <= tolerance
        if still or (self.pure and gain and objective - self.best <= gain * (1 + abs(objective))):
            return Row(self.here, objective, self.here, following, False, False, n, True, True)
        if self.pure and leaps:
            return Row(self.here, objective, leap(self.good, self.here, following), following, True, False, n, False, False)
        return Row(self.here, objective, following, following, False, True, n, False, False)


_ARRAYS = ("good", "here", "ahead")
_KINDS = {"good": "array<double>", "best": "double", "here": "array<double>", "ahead": "array<double>", "leaping": "boolean", "pure": "boolean", "iterations": "int", "converged": "boolean", "done": "boolean"}
_ARROW = {"array<double>": pa.list_(pa.float64()), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}


def _stepped(joined: DataFrame, key: str, tolerance: float, leaps: bool, gain: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in (*_KINDS, "objective", "next")}
            out = []
            for k in range(len(batch)):
                row = Row(**{c: np.array(columns[c][k]) if c in _ARRAYS else columns[c][k] for c in _KINDS})
                following = columns["next"][k]
                if row.done:
                    out.append(row)
                    continue
                out.append(row.after(columns["objective"][k], None if following is None else np.array(following), tolerance, leaps, gain))
            values = [pa.array([getattr(r, c).tolist() if c in _ARRAYS else getattr(r, c) for r in out], _ARROW[kind]) for c, kind in _KINDS.items()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *values], names=[key, *_KINDS])

    return joined.mapInArrow(run, f"`{key}` {dict(joined.dtypes)[key]}, " + ", ".join(f"{c} {k}" for c, k in _KINDS.items()))


def accelerated(step: Step, start: DataFrame, key: str = "species", iterations: int = 200, tolerance: float = 1e-4, leaps: bool = True, gain: float = 1e-7) -> DataFrame:
    """Repeat ``step`` until every row has converged: (key, theta, objective, iterations, converged).

    A row has converged when a step moves its theta by at most ``tolerance``, or when a plain step
    raises its objective by at most ``gain`` of itself, as at a bound, where theta moves for ever.

    With ``leaps`` each plain EM step is followed by a squared extrapolation, which is kept only
    if the objective did not fall; otherwise the row goes on from the
    EM step.  A plain step that lowers the objective (as a Newton step in place
    of a full maximisation may) is halved.  Rows stop one by one; a row that still moves
    after ``iterations`` jobs comes back as not converged.  The objective
    belongs to the returned theta.
    """
    state = settle(
        start.selectExpr(
            key, "theta as good", "cast(null as double) as best", "theta as here", "theta as ahead", "false as leaping", "false as pure",
            "0 as iterations", "false as converged", "false as done",
        )
    )
    for _ in range(iterations):
        moving = state.where("not done")
        # merged: tables of this size in one partition each are not worth a broadcast, which is a job of its own
        found = step(moving.select(key, F.col("here").alias("theta"))).select(key, "objective", "next").hint("merge")
        # rows that are done pass through the same join: a union would add partitions at every step
        state = settle(_stepped(state.join(found, key, "left"), key, tolerance, leaps, gain))
        if state.where("not done").isEmpty():
            break
    return state.select(key, F.col("good").alias("theta"), F.col("best").alias("objective"), "iterations", "converged")


def _scores_around(score: Score, thetas: DataFrame, key: str, width: float) -> DataFrame:
    """(key, __scores): the scores at theta shifted down and up by ``width`` in each place, one after the other; one job for all rows."""
    # in SQL, as a fit makes this plan anew in every pass
    shifts = "inline(flatten(transform(sequence(0, size(theta) - 1), i -> array(named_struct('at', i, 'sign', -1), named_struct('at', i, 'sign', 1)))))"
    shifted = thetas.selectExpr(f"`{key}` as __of", "theta", shifts).selectExpr(
        f"struct(__of, at, sign) as `{key}`", f"transform(theta, (x, i) -> if(i = at, x + sign * {width!r}D, x)) as theta"
    )
    slopes = score(shifted).selectExpr(f"`{key}`.__of as `{key}`", f"struct(`{key}`.at, `{key}`.sign, score) as __s")
    return slopes.groupBy(key).agg(F.expr("flatten(transform(array_sort(collect_list(__s)), x -> x.score)) as __scores"))


def information(scores: list[float], width: float) -> tuple[np.ndarray, np.ndarray]:
    """Score and observed information at theta, from the scores around it."""
    n = int(round((len(scores) / 2) ** 0.5))
    both = np.array(scores).reshape(n, 2, n)
    info = -(both[:, 1] - both[:, 0]) / (2 * width)
    return both.mean(axis=(0, 1)), (info + info.T) / 2


def newton_steps(step: Step, score: Score, key: str = "species", width: float = 1e-4, floor: float = 0.05) -> Step:
    """Newton steps on the objective itself in place of EM steps, for the end of a fit.

    Directions of less curvature than ``floor`` (or of the wrong sign) count as if they had
    it, so that flat ones are walked and not jumped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for theta, scores in zip(batch.column("theta").to_pylist(), batch.column("__scores").to_pylist()):
                slope, info = information(scores, width) if scores else (np.full(1, np.nan), np.full((1, 1), np.nan))
                if not (np.isfinite(slope).all() and np.isfinite(info).all()):
                    out.append(theta)
                    continue
                curve, way = np.linalg.eigh(info)
                out.append((np.array(theta) + way @ ((way.T @ slope) / np.maximum(np.abs(curve), floor))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("objective"), pa.array(out, _ARROW["array<double>"])], names=[key, "objective", "next"])

    def newton(thetas: DataFrame) -> DataFrame:
        around = thetas.join(_scores_around(score, thetas, key, width).hint("merge"), key)
        rows = around.join(step(thetas).select(key, "objective").hint("merge"), key).select(key, "objective", "theta", "__scores")
        return rows.mapInArrow(run, f"`{key}` {dict(thetas.dtypes)[key]}, objective double, next array<double>")

    return newton


def finished(step: Step, score: Score, start: DataFrame, key: str = "species", iterations: int = 200, tolerance: float = 1e-4, gain: float = 1e-6, warm: int = 10) -> DataFrame:
    """Accelerated EM for at most ``warm`` jobs, which finds the region of the maximum, then Newton steps to it.

    EM slows down where data say little; Newton steps do not, so that one which gains no more than ``gain``
    of the objective is the end.  ``iterations`` counts the passes of both.
    """
    if iterations <= warm:
        return accelerated(step, start, key, iterations, tolerance)
    near = accelerated(step, start, key, warm, tolerance, gain=0.0)
    # a row that EM has finished is confirmed by one Newton step
    end = accelerated(newton_steps(step, score, key), near.select(key, "theta"), key, iterations - warm, tolerance, leaps=False, gain=gain)
    before = near.select(key, F.col("iterations").alias("__before"))
    return end.join(before, key).withColumn("iterations", F.col("iterations") + F.col("__before")).drop("__before")


def with_errors(score: Score, fitted: DataFrame, key: str = "species", width: float = 1e-4) -> DataFrame:
    """Add ``errors`` (standard errors) and ``variances`` (the covariance, row by row) to a fit.

    The observed information is the derivative of the score, taken by central
    differences of ``width``.  Where it is not positive definite, as at a bound, both are null.
    """
    settled = settle(fitted)
    joined = settled.join(_scores_around(score, settled, key, width), key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, variances = [], []
            for scores in batch.column("__scores").to_pylist():
                e = v = None
                if scores is not None:
                    _, info = information(scores, width)
                    if np.isfinite(info).all() and np.linalg.eigvalsh(info).min() > 0:
                        v = np.linalg.inv(info)
                        e, v = np.sqrt(np.diag(v)).tolist(), v.ravel().tolist()
                errors.append(e)
                variances.append(v)
            kept = [c for c in batch.schema.names if c != "__scores"]
            doubles = _ARROW["array<double>"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(errors, doubles), pa.array(variances, doubles)], names=[*kept, "errors", "variances"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in settled.schema)
    return joined.mapInArrow(run, f"{plain}, errors array<double>, variances array<double>")
