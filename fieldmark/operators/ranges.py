"""Which points lie in which polygons, by a cover of cells.

A square is cut into 2^l x 2^l cells at level l.  A polygon's cover has large cells
inside and small ones along its edges: a cell that no edge touches lies inside or
outside as a whole and is not cut further.  Points meet the cover by equality of
cells; only points in the smallest border cells are tested against edges, and only those of
their own row.  Nothing is broadcast and no point meets a polygon far from it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.session import settle


@dataclass(frozen=True)
class Square:
    """Lower left corner and side; cells are counted from there."""

    left: float
    bottom: float
    side: float

    def cell(self, at: Column, level: int, upright: bool) -> Column:
        return F.floor((at - (self.bottom if upright else self.left)) * (2**level / self.side))

    def inside(self, x: Column, y: Column) -> Column:
        return x.between(self.left, self.left + self.side) & y.between(self.bottom, self.bottom + self.side)


def border_cells(edges: DataFrame, square: Square, level: int) -> DataFrame:
    """Distinct (poly_id, cx, cy) that an edge touches at a level: row by row, the columns between where the edge enters and leaves."""
    size, pad = square.side / 2**level, square.side * 1e-9
    low, high = F.least("y1", "y2") - pad, F.greatest("y1", "y2") + pad
    last = F.lit(2**level - 1)
    clip = lambda c: F.greatest(F.lit(0), F.least(last, c)).cast("int")
    rows = edges.withColumn("cy", F.explode(F.sequence(clip(square.cell(low, level, True)), clip(square.cell(high, level, True)))))
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    lower, upper = F.lit(square.bottom) + F.col("cy") * size - pad, F.lit(square.bottom) + (F.col("cy") + 1) * size + pad
    at = lambda y: F.coalesce(F.col("x1") + (F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2")) - F.col("y1")) * slope, F.col("x1"))
    flat = F.col("y1") == F.col("y2")
    a, b = F.when(flat, F.col("x1")).otherwise(at(lower)), F.when(flat, F.col("x2")).otherwise(at(upper))
    first, final = square.cell(F.least(a, b) - pad, level, False), square.cell(F.greatest(a, b) + pad, level, False)
    return rows.select("poly_id", "cy", F.explode(F.sequence(clip(first), clip(final))).alias("cx")).distinct()


def _right_of(points: DataFrame, edges: DataFrame, square: Square, level: int, keys: list[str]) -> DataFrame:
    """``points`` (keys, poly_id, x, y) that an odd number of their polygon's edges pass on the right; edges are met by row."""
    span = lambda c: F.greatest(F.lit(0), F.least(F.lit(2**level - 1), square.cell(F.col(c), level, True))).cast("int")
    rows = edges.where("y1 <> y2").withColumn("cy", F.explode(F.sequence(F.least(span("y1"), span("y2")), F.greatest(span("y1"), span("y2")))))
    row = F.greatest(F.lit(0), F.least(F.lit(2**level - 1), square.cell(F.col("y"), level, True))).cast("int")
    met = points.withColumn("cy", row).join(rows, ["poly_id", "cy"])
    passes = (F.col("y") >= F.least("y1", "y2")) & (F.col("y") < F.greatest("y1", "y2")) & (
        F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    )
    return met.where(passes).groupBy(*keys, "poly_id").agg(F.count("*").alias("__n")).where("__n % 2 = 1").drop("__n")


def cover(edges: DataFrame, square: Square, levels: int) -> tuple[DataFrame, DataFrame]:
    """(inside cells of all levels, border cells of the last): (poly_id, level, cx, cy) and (poly_id, cx, cy).

    ``edges`` (poly_id, x1, y1, x2, y2) close their rings, one or several for
    a polygon; a point with an odd number of edges to its right is inside.  Polygons
    may reach beyond the square; only what lies in it is covered.
    """
    edges = settle(edges.select("poly_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).dropna())
    found = []
    above = edges.select("poly_id").distinct().select("poly_id", F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    for level in range(1, levels + 1):
        size = square.side / 2**level
        border = settle(border_cells(edges, square, level))
        corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        quarters = above.withColumn("q", corner).select("poly_id", (F.col("cx") * 2 + F.col("q.i")).alias("cx"), (F.col("cy") * 2 + F.col("q.j")).alias("cy"))
        free = quarters.join(border, ["poly_id", "cx", "cy"], "left_anti")
        centred = free.withColumns({"x": F.lit(square.left) + (F.col("cx") + 0.5) * size, "y": F.lit(square.bottom) + (F.col("cy") + 0.5) * size})
        held = _right_of(centred.withColumnRenamed("cy", "row"), edges, square, level, ["cx", "row"]).withColumnRenamed("row", "cy")
        found.append(held.select("poly_id", F.lit(level).alias("level"), "cx", "cy"))
        # border cells outside the quarters of the level above cannot be: an edge that touches a cell touches the one around it
        above = border
    return reduce(DataFrame.unionByName, found), above


def points_in_polygons(points: DataFrame, edges: DataFrame, square: Square, levels: int = 7, x: str = "x", y: str = "y") -> DataFrame:
    """Distinct (x, y, poly_id) of points inside polygons; points outside the square are in none.

    Points are taken by distinct coordinates, so repeated places are tested once.
    """
    inside, border = cover(edges, square, levels)
    places = settle(points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().distinct())
    within = places.where(square.inside(F.col("x"), F.col("y")))
    cell = lambda level, upright: F.least(F.lit(2**level - 1), square.cell(F.col("y" if upright else "x"), level, upright)).cast("int")
    steps = F.array(*[F.struct(F.lit(k).alias("level"), cell(k, False).alias("cx"), cell(k, True).alias("cy")) for k in range(1, levels + 1)])
    sure = within.select("x", "y", F.inline(steps)).join(inside, ["level", "cx", "cy"]).select("x", "y", "poly_id")
    near = within.withColumns({"cx": cell(levels, False), "cy": cell(levels, True)}).join(border, ["cx", "cy"]).select("x", "y", "poly_id")
    plain = edges.select("poly_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).dropna()
    return sure.unionByName(_right_of(near, plain, square, levels, ["x", "y"]).select("x", "y", "poly_id"))
