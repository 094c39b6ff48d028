"""Raster work on pixel tables: one row per (layer, row, column).

Rows count from the top, columns from the left, both from 0.  Everything is
arithmetic on the indices plus equi-joins on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.functions.projection import Albers, albers_lonlat, albers_xy
from fieldmark.session import BROADCAST_ROWS, settle


@dataclass(frozen=True)
class Grid:
    """Top-left corner, cell size and shape."""

    left: float
    top: float
    res: float
    nrow: int
    ncol: int


def cell_number(row: Column | str, col: Column | str, ncol: int) -> Column:
    """Row-major cell number from 1."""
    row = F.col(row) if isinstance(row, str) else row
    col = F.col(col) if isinstance(col, str) else col
    return row.cast("long") * ncol + col + 1


def point_cell(x: Column | str, y: Column | str, grid: Grid) -> Column:
    """Cell number of a point, NULL outside the grid."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    c = F.floor((x - grid.left) / grid.res)
    r = F.floor((F.lit(grid.top) - y) / grid.res)
    inside = c.between(0, grid.ncol - 1) & r.between(0, grid.nrow - 1)
    return F.when(inside, cell_number(r, c, grid.ncol))


def percent_cover(pixels: DataFrame, classes: Sequence[int], fact: int, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Share of each class in blocks of ``fact`` x ``fact`` pixels, long form.

    Missing pixels leave the share.  One aggregation serves all classes.
    """
    blocks = pixels.withColumns(
        {"brow": F.floor(F.col("prow") / fact).cast("int"), "bcol": F.floor(F.col("pcol") / fact).cast("int")}
    )
    wide = blocks.groupBy(*by, "brow", "bcol").agg(
        *[F.avg((F.col(value) == k).cast("double")).alias(str(k)) for k in classes]
    )
    return wide.unpivot([*by, "brow", "bcol"], [str(k) for k in classes], "class", "cover").withColumn(
        "class", F.col("class").cast("int")
    )


def layer_difference(later: DataFrame, earlier: DataFrame, keys: Sequence[str], value: str, name: str = "change") -> DataFrame:
    a = later.select(*keys, F.col(value).alias("__a"))
    b = earlier.select(*keys, F.col(value).alias("__b"))
    return a.join(b, list(keys)).select(*keys, (F.col("__a") - F.col("__b")).alias(name))


def stack_layers(pixels: DataFrame, layers: Sequence[str], keys: Sequence[str] = ("prow", "pcol")) -> DataFrame:
    """Long pixel table -> one row per cell with a column per layer.

    A (cell, layer) has one pixel, so conditional maxima align the layers in a
    single aggregation instead of a join per layer.
    """
    return pixels.groupBy(*keys).pivot("layer", list(layers)).agg(F.max("value"))


def crop(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return pixels.where(F.col("prow").between(*rows) & F.col("pcol").between(*cols))


def reclassify(pixels: DataFrame, lookup: Mapping[int, int], value: str = "value", name: str = "class") -> DataFrame:
    """Map raw classes to coarser ones; a class that is not listed gives NULL."""
    codes = F.create_map(*[F.lit(v) for pair in lookup.items() for v in pair])
    return pixels.withColumn(name, F.try_element_at(codes, F.col(value)))


def region_spans(edges: DataFrame, grid: Grid) -> DataFrame:
    """Polygons -> runs of columns per raster row: (poly_id, prow, first_col, last_col).

    Each edge is cut at the row centres that it spans, and the crossings of a
    row, in order of x, open and close a run.  The half-open rule puts a centre
    that lies on a left or lower edge inside.  A window group holds the
    crossings of one polygon with one row.
    """
    half = grid.res / 2
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # Row centres y = top - half - r * res with low <= y < high.
    first = F.floor((F.lit(grid.top - half) - high) / grid.res).cast("int") + 1
    last = F.floor((F.lit(grid.top - half) - low) / grid.res).cast("int")
    cut = edges.where("y1 <> y2").withColumns(
        {"__first": F.greatest(first, F.lit(0)), "__last": F.least(last, F.lit(grid.nrow - 1))}
    )
    crossings = (
        cut.where("__first <= __last")
        .withColumn("prow", F.explode(F.sequence("__first", "__last")))
        .withColumn("__y", F.lit(grid.top - half) - F.col("prow") * grid.res)
        .withColumn("__x", F.col("x1") + (F.col("__y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    )
    along = Window.partitionBy("poly_id", "prow").orderBy("__x")
    # Column centres x = left + half + c * res with open <= x < close.
    to_col = lambda x: F.ceil((x - F.lit(grid.left + half)) / grid.res).cast("int")
    return (
        crossings.withColumns({"__k": F.row_number().over(along), "__close": F.lead("__x").over(along)})
        .where("__k % 2 = 1 and __close is not null")
        .select(
            "poly_id",
            "prow",
            F.greatest(to_col(F.col("__x")), F.lit(0)).alias("first_col"),
            F.least(to_col(F.col("__close")) - 1, F.lit(grid.ncol - 1)).alias("last_col"),
        )
        .where("first_col <= last_col")
    )


def region_cells(edges: DataFrame, grid: Grid) -> DataFrame:
    """Distinct (prow, pcol) whose centre lies in any of the polygons."""
    return _covered(edges, grid).distinct()


def _covered(edges: DataFrame, grid: Grid) -> DataFrame:
    return region_spans(edges, grid).select("prow", F.explode(F.sequence("first_col", "last_col")).alias("pcol"))


def mask(pixels: DataFrame, edges: DataFrame, grid: Grid) -> DataFrame:
    """Pixels whose cell centre is in the region: a semi-join on the row, with the run of columns as a range.

    The region is settled as one run per row and crossing pair, so its size is known; pixels
    outside its bounding box are left out before the join.  Runs that are too
    many to broadcast are expanded to cells and joined on these.
    """
    spans = settle(region_spans(edges, grid).select("prow", "first_col", "last_col"))
    box = spans.agg(
        F.struct(F.min("prow").alias("r0"), F.max("prow").alias("r1"), F.min("first_col").alias("c0"), F.max("last_col").alias("c1"))
    ).scalar()
    near = pixels.where(F.col("prow").between(box["r0"], box["r1"]) & F.col("pcol").between(box["c0"], box["c1"]))
    if spans.count() <= BROADCAST_ROWS:
        runs = F.broadcast(spans.withColumnRenamed("prow", "__row"))
        inside = (F.col("prow") == F.col("__row")) & F.col("pcol").between(F.col("first_col"), F.col("last_col"))
        return near.join(runs, inside, "left_semi")
    cells = spans.select("prow", F.explode(F.sequence("first_col", "last_col")).alias("pcol"))
    return near.join(cells, ["prow", "pcol"], "left_semi")


def grid_shape(pixels: DataFrame) -> tuple[int, int]:
    """(nrow, ncol) of a pixel table that lacks metadata: one aggregated row."""
    top = pixels.agg(F.max("prow"), F.max("pcol")).first()
    return int(top[0]) + 1, int(top[1]) + 1


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """All (trow, tcol) of a grid, generated in parallel."""
    n = F.lit(grid.ncol)
    return spark.range(grid.nrow * grid.ncol).select(
        F.floor(F.col("id") / n).cast("int").alias("trow"), F.pmod(F.col("id"), n).cast("int").alias("tcol")
    )


def bilinear_resample(pixels: DataFrame, source: Grid, target: Grid, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Values of ``pixels`` at the target grid's cell centres; both grids are in the same coordinates."""
    return warp(pixels, source, target, lambda x, y: (x, y), by, value)


def warp(pixels: DataFrame, source: Grid, target: Grid, position: Callable[[Column, Column], tuple[Column, Column]], by: Sequence[str] = (), value: str = "value", nearest: bool = False) -> DataFrame:
    """Values of ``pixels`` at the target grid's cell centres: (by, trow, tcol, value).

    ``position`` takes a target cell's centre to the coordinates of the source
    grid.  Each target cell asks for its four source neighbours (an equi-join on the
    source cell), and the weighted values are summed back; with ``nearest`` it asks for the cell that
    holds its centre, as classes must.  Neighbours past the
    border repeat the border cell; missing neighbours leave the weights; cells whose
    centre lies outside the source, or nowhere, are not returned.
    """
    x, y = position(F.lit(target.left) + (F.col("tcol") + 0.5) * target.res, F.lit(target.top) - (F.col("trow") + 0.5) * target.res)
    sx = (x - source.left) / source.res - 0.5
    sy = (F.lit(source.top) - y) / source.res - 0.5
    placed = grid_cells(pixels.sparkSession, target).withColumns({"__sx": sx, "__sy": sy})
    placed = placed.where(F.col("__sx").between(-0.5, source.ncol - 0.5) & F.col("__sy").between(-0.5, source.nrow - 0.5))
    given = pixels.where(F.col(value).isNotNull()).select(*by, "prow", "pcol", F.col(value).alias("__v"))
    inside = lambda c, last: F.greatest(F.lit(0), F.least(F.lit(last), c)).cast("int")
    if nearest:
        row, column = inside(F.floor(F.col("__sy") + 0.5), source.nrow - 1), inside(F.floor(F.col("__sx") + 0.5), source.ncol - 1)
        return placed.select("trow", "tcol", row.alias("prow"), column.alias("pcol")).join(given, ["prow", "pcol"]).select(*by, "trow", "tcol", F.col("__v").alias(value))
    placed = placed.withColumns({"__c": F.floor("__sx").cast("int"), "__r": F.floor("__sy").cast("int")})
    fx, fy = F.col("__sx") - F.col("__c"), F.col("__sy") - F.col("__r")

    def corner(dr: int, dc: int) -> Column:
        row, column = inside(F.col("__r") + dr, source.nrow - 1), inside(F.col("__c") + dc, source.ncol - 1)
        weight = (fy if dr else 1 - fy) * (fx if dc else 1 - fx)
        return F.struct(row.alias("prow"), column.alias("pcol"), weight.alias("w"))

    corners = placed.select("trow", "tcol", F.inline(F.array(*[corner(r, c) for r in (0, 1) for c in (0, 1)]))).where("w > 0")
    return (
        corners.join(given, ["prow", "pcol"])
        .groupBy(*by, "trow", "tcol")
        .agg(F.try_divide(F.sum(F.col("w") * F.col("__v")), F.sum("w")).alias(value))
    )


def projected_grid(spark: SparkSession, source: Grid, position: Callable[[Column, Column], tuple[Column, Column]], res: float) -> Grid:
    """The grid of cells of ``res``, on multiples of it, that covers ``source`` seen through ``position``.

    The border of the source bounds its image; its corner points are one aggregated row.
    """
    along = spark.range(2 * (source.nrow + 1) + 2 * (source.ncol + 1)).withColumn("k", F.pmod("id", F.lit(source.nrow + source.ncol + 2)))
    far = F.col("id") >= source.nrow + source.ncol + 2
    edge = F.col("k") <= source.nrow
    row = F.when(edge, F.col("k")).when(far, F.lit(source.nrow)).otherwise(0)
    column = F.when(~edge, F.col("k") - (source.nrow + 1)).when(far, F.lit(source.ncol)).otherwise(0)
    x, y = position(F.lit(source.left) + column * source.res, F.lit(source.top) - row * source.res)
    x0, x1, y0, y1 = along.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    left, top = math.floor(x0 / res) * res, math.ceil(y1 / res) * res
    return Grid(left, top, res, math.ceil((top - y0) / res), math.ceil((x1 - left) / res))


def project_raster(pixels: DataFrame, source: Grid, crs: Albers, res: float, by: Sequence[str] = (), value: str = "value", nearest: bool = False) -> tuple[DataFrame, Grid]:
    """A raster in degrees, in another coordinate system: (pixels by trow and tcol, their grid in metres).

    Every target cell finds its source position by the inverse projection, so the result has no holes.
    """
    target = projected_grid(pixels.sparkSession, source, lambda x, y: albers_xy(x, y, crs), res)
    return warp(pixels, source, target, lambda x, y: albers_lonlat(x, y, crs), by, value, nearest), target
