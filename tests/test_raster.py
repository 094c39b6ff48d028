import random

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import raster
from fieldmark.sources import polygons


def grid_pixels(spark, nrow, ncol, fn):
    return spark.createDataFrame([(r, c, fn(r, c)) for r in range(nrow) for c in range(ncol)], "prow int, pcol int, value double")


def inside(x, y, edges):
    """Odd number of edges to the right of a point, lower ends included."""
    n = 0
    for x1, y1, x2, y2 in edges:
        if min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            n += 1
    return n % 2 == 1


@pytest.mark.parametrize("seed", range(4))
def test_region_against_ray_casting(spark, seed):
    """Random (self-crossing) rings, some outside the grid, on a shifted grid."""
    r = random.Random(seed)
    grid = raster.Grid(left=-3.0, top=11.0, res=0.5, nrow=30, ncol=24)
    ring = [(r.uniform(-5, 11), r.uniform(-6, 13)) for _ in range(9)]
    edges = [(*ring[i], *ring[(i + 1) % 9]) for i in range(9)]
    df = spark.createDataFrame([(1, *e) for e in edges], "poly_id long, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(x) for x in raster.region_cells(df, grid).collect()}
    want = {
        (i, j) for i in range(30) for j in range(24) if inside(-3 + (j + 0.5) * 0.5, 11 - (i + 0.5) * 0.5, edges)
    }
    assert got == want


def test_cell_on_the_edge_belongs_to_the_left_and_lower_side(spark):
    grid = raster.Grid(0.0, 4.0, 1.0, 4, 4)
    box = [(0.5, 0.5, 2.5, 0.5), (2.5, 0.5, 2.5, 2.5), (2.5, 2.5, 0.5, 2.5), (0.5, 2.5, 0.5, 0.5)]
    df = spark.createDataFrame([(1, *map(float, e)) for e in box], "poly_id long, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(x) for x in raster.region_cells(df, grid).collect()}
    assert got == {(2, 0), (2, 1), (3, 0), (3, 1)}


def test_points_outside_have_no_cell(spark):
    grid = raster.Grid(0.0, 10.0, 2.0, 5, 4)
    pts = [(0.0, 10.0), (7.9, 0.1), (8.0, 5.0), (-0.1, 5.0), (2.0, 8.0), (3.0, 0.0)]
    df = spark.createDataFrame(pts, "x double, y double").coalesce(1)
    got = [r[0] for r in df.select(raster.point_cell("x", "y", grid)).collect()]
    assert got == [1, 20, None, None, 6, None]


def test_class_shares_sum_to_one_and_skip_missing(spark):
    px = spark.createDataFrame(
        [(r, c, None if (r, c) == (0, 0) else (r + c) % 3) for r in range(5) for c in range(5)], "prow int, pcol int, value int"
    )
    got = raster.percent_cover(px, [0, 1, 2], 2)
    assert all(abs(x[0] - 1) < 1e-12 for x in got.groupBy("brow", "bcol").agg(F.sum("cover")).select("sum(cover)").collect())
    assert got.where("brow = 0 and bcol = 0 and class = 1").first().cover == pytest.approx(2 / 3)


def test_bilinear_reproduces_a_plane_and_the_same_grid(spark):
    px = grid_pixels(spark, 8, 8, lambda r, c: 2.0 * r + 3.0 * c)
    src = raster.Grid(0.0, 8.0, 1.0, 8, 8)
    same = raster.bilinear_resample(px, src, src)
    assert same.join(px.toDF("trow", "tcol", "v"), ["trow", "tcol"]).where("abs(value - v) > 1e-9").count() == 0
    fine = raster.bilinear_resample(px, src, raster.Grid(2.0, 6.0, 0.5, 8, 8)).collect()
    assert len(fine) == 64
    for r in fine:
        assert r.value == pytest.approx(2.0 * ((8 - (6 - (r.trow + 0.5) * 0.5)) - 0.5) + 3.0 * (2 + (r.tcol + 0.5) * 0.5 - 0.5))


def test_bilinear_leaves_out_missing_neighbours_and_cells_outside(spark):
    px = grid_pixels(spark, 2, 2, lambda r, c: None if (r, c) == (0, 0) else 5.0)
    src = raster.Grid(0.0, 2.0, 1.0, 2, 2)
    got = raster.bilinear_resample(px, src, raster.Grid(0.5, 3.5, 1.0, 4, 1)).collect()
    assert sorted((r.trow, r.value) for r in got) == [(1, 5.0), (2, 5.0), (3, 5.0)]


def test_stack_recode_difference(spark):
    px = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 4.0), ("a", 0, 1, 2.0)], "layer string, prow int, pcol int, value double")
    got = {(r.prow, r.pcol): (r.a, r.b) for r in raster.stack_layers(px, ["a", "b"]).collect()}
    assert got == {(0, 0): (1.0, 4.0), (0, 1): (2.0, None)}
    codes = px.withColumn("value", F.col("value").cast("int"))
    assert [r[0] for r in raster.reclassify(codes, {1: 7, 4: 8}).orderBy("value").select("class").collect()] == [7, None, 8]
    diff = raster.layer_difference(px.where("layer='a'"), px.where("layer='b'"), ["prow", "pcol"], "value")
    assert [tuple(r) for r in diff.collect()] == [(0, 0, -3.0)]
    assert raster.crop(px, (0, 0), (1, 1)).count() == 1


def test_edges_close_each_ring_and_subset_by_attribute(spark):
    v = spark.createDataFrame(
        [(1, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "poly_id long, ring int, seq int, x double, y double"
    )
    e = polygons.edges_from_vertices(v)
    assert {(r.x1, r.y1, r.x2, r.y2) for r in e.collect()} == {(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 0)}
    tagged = e.withColumns({"SCINAME": F.lit("Vireo griseus"), "SEASONAL": F.lit(3), "BCRNumber": F.lit(28)})
    assert polygons.subset_polygons(tagged, "BCRNumber", [28, 29]).count() == 3
    assert polygons.subset_polygons(tagged, "BCRNumber", [28], seasons=[1, 2]).count() == 0
    names = spark.createDataFrame([("Vireo griseus",)], "scientific_name string")
    assert polygons.subset_by_species(tagged, names, [3]).count() == 3
    assert polygons.subset_by_species(tagged, names, [1, 2]).count() == 0
