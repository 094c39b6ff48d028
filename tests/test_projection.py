"""Inverse projection by round trips, and rasters through it."""

import math

import pytest
from pyspark.sql import functions as F

from fieldmark.functions.projection import Albers, albers_lonlat, albers_xy
from fieldmark.operators import raster


@pytest.mark.parametrize("crs", [Albers(), Albers(flattening=0.0), Albers(lat1=-20.0, lat2=-60.0, lat0=-30.0, lon0=25.0), Albers(lat1=40.0, lat2=40.0)])
def test_points_come_back_below_a_millimetre(spark, crs):
    south = -1 if crs.lat0 < 0 else 1
    points = spark.range(19 * 21).select((F.col("id") % 21 * 5 - 50 + crs.lon0).alias("lon"), (F.floor(F.col("id") / 21) * 4.7 * south).alias("lat"))
    x, y = albers_xy("lon", "lat", crs)
    lon, lat = albers_lonlat("x", "y", crs)
    rows = points.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect()
    metres = crs.radius * math.pi / 180
    for r in rows:
        assert abs(r.b - r.lat) * metres < 1e-4
        assert abs(r.a - r.lon) * metres * math.cos(math.radians(r.lat)) < 1e-4


def test_worked_example(spark):
    """Snyder 1987, page 292: the Clarke 1866 ellipsoid."""
    crs = Albers(lat1=29.5, lat2=45.5, lat0=23.0, lon0=-96.0, radius=6378206.4, flattening=1 - math.sqrt(1 - 0.00676866))
    lon, lat = albers_lonlat(F.lit(1885472.7), F.lit(1535925.0), crs)
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert row.lon == pytest.approx(-75.0, abs=1e-5) and row.lat == pytest.approx(35.0, abs=1e-5)


def test_no_latitude_gives_null(spark):
    lon, lat = albers_lonlat(F.lit(9e7), F.lit(0.0))
    assert spark.range(1).select(lat.alias("lat")).first().lat is None


def test_projected_raster_follows_a_plane(spark):
    """Bilinear sampling of a field linear in the coordinates gives the field at each target centre."""
    source, crs, res = raster.Grid(-98.0, 41.0, 0.05, 40, 60), Albers(), 9000.0
    px = spark.range(40 * 60).select(F.floor(F.col("id") / 60).cast("int").alias("prow"), (F.col("id") % 60).cast("int").alias("pcol"))
    px = px.withColumn("value", 3.0 * (source.left + (F.col("pcol") + 0.5) * source.res) - 2.0 * (source.top - (F.col("prow") + 0.5) * source.res))
    out, grid = raster.project_raster(px, source, crs, res)
    lon, lat = albers_lonlat(F.lit(grid.left) + (F.col("tcol") + 0.5) * res, F.lit(grid.top) - (F.col("trow") + 0.5) * res, crs)
    rows = out.withColumns({"lon": lon, "lat": lat}).collect()
    inner = [r for r in rows if -97.9 < r.lon < -95.1 and 39.1 < r.lat < 40.9]
    assert len(inner) > 300 and all(r.value == pytest.approx(3 * r.lon - 2 * r.lat, abs=1e-9) for r in inner)
    assert {(r.trow, r.tcol) for r in rows} <= {(i, j) for i in range(grid.nrow) for j in range(grid.ncol)}
    near, _ = raster.project_raster(px, source, crs, res, nearest=True)
    assert {r.value for r in near.collect()} <= {r.value for r in px.collect()}


def test_layers_stay_apart_and_holes_are_left_out(spark):
    source = raster.Grid(-98.0, 41.0, 0.5, 4, 4)
    px = spark.range(16).select(F.floor(F.col("id") / 4).cast("int").alias("prow"), (F.col("id") % 4).cast("int").alias("pcol"))
    two = px.withColumn("layer", F.lit("a")).withColumn("value", F.lit(1.0)).unionByName(px.withColumn("layer", F.lit("b")).withColumn("value", F.when(F.col("pcol") < 2, 7.0)))
    out, _ = raster.project_raster(two, source, Albers(), 30_000.0, by=["layer"])
    values = {(r.layer, round(r.value, 9)) for r in out.collect()}
    assert values == {("a", 1.0), ("b", 7.0)}
    counts = {r.layer: r["count"] for r in out.groupBy("layer").count().collect()}
    assert counts["b"] < counts["a"]
