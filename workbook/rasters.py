"""Pixel tables, points, regions, scaling, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.projection import Albers, albers_xy
from fieldmark.operators import raster, relational, scaling
from workbook import standins as S
from workbook.registry import query, rounded

BLOCK = 10
CLASSES = range(5)


def _long(spark: SparkSession, sf: str) -> DataFrame:
    """Two class layers in long form."""
    return S.pixels(spark, sf).select("prow", "pcol", F.col("lc").alias("later"), F.col("lc_before").alias("earlier")).unpivot(
        ["prow", "pcol"], ["later", "earlier"], "layer", "value"
    )


LONG = """layers as (
  select prow, pcol, 'later' as layer, lc as value from pixels
  union all select prow, pcol, 'earlier', lc_before from pixels)"""

COVER = f"""cover as (
  select layer, prow // {BLOCK} as brow, pcol // {BLOCK} as bcol, k as class,
    avg(case when value = k then 1.0::double else 0.0 end) as cover
  from layers, range(5) c(k) group by 1, 2, 3, 4)"""


@query(S.sql(S.PIXELS, LONG, COVER, "select layer, brow, bcol, class, round(cover, 6) as cover from cover"))
def percent_cover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(raster.percent_cover(_long(spark, sf), CLASSES, BLOCK, by=["layer"]), "cover")


@query(
    S.sql(
        S.PIXELS, LONG, COVER,
        """select a.brow, a.bcol, a.class, round(a.cover - b.cover, 6) as change from cover a join cover b
          on a.brow = b.brow and a.bcol = b.bcol and a.class = b.class
        where a.layer = 'later' and b.layer = 'earlier' and a.class not in (0, 2)""",
    )
)
def cover_change(spark: SparkSession, sf: str) -> DataFrame:
    """Change of class shares between two layers, without two of the classes."""
    cover = raster.percent_cover(_long(spark, sf), CLASSES, BLOCK, by=["layer"]).where(~F.col("class").isin(0, 2))
    change = raster.layer_difference(
        cover.where("layer = 'later'"), cover.where("layer = 'earlier'"), ["brow", "bcol", "class"], "cover"
    )
    return rounded(change, "change")


@query(S.sql(S.PIXELS, "select prow, pcol, lc as later, lc_before as earlier from pixels"))
def stack_layers(spark: SparkSession, sf: str) -> DataFrame:
    return raster.stack_layers(_long(spark, sf), S.LAYERS)


@query(
    S.sql(
        S.PIXELS,
        "select prow * 100 + pcol + 1 as cell, lc as later, lc_before as earlier from pixels where lc <> 4 and lc_before <> 4",
    )
)
def layer_complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Stacked layers with class 4 as no-data: only cells with all layers stay."""
    given = _long(spark, sf).where("value <> 4")
    stacked = raster.stack_layers(given, S.LAYERS)
    return relational.complete_rows(stacked).select(
        raster.cell_number("prow", "pcol", 100).alias("cell"), "later", "earlier"
    )


POINTS_GRID = raster.Grid(left=-98.0, top=48.0, res=0.5, nrow=40, ncol=50)


@query(
    S.sql(
        S.CHECKLISTS,
        """located as (select event_id, floor((raw_longitude + 98) / 0.5) as c, floor((48 - raw_latitude) / 0.5) as r from checklists)""",
        """select event_id, cast(case when c between 0 and 49 and r between 0 and 39 then r * 50 + c + 1 end as bigint) as cell from located""",
    )
)
def point_to_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Cell of each checklist; NULL when it lies outside the grid."""
    lists = S.checklists(spark, sf)
    return lists.select("event_id", raster.point_cell("raw_longitude", "raw_latitude", POINTS_GRID).alias("cell"))


# Two regions: a concave outline and a triangle, scaled to the raster's height.
REGION_VERTICES = (
    (28, ((10.2, 0.1), (80.6, 0.1), (80.6, 0.9), (45.3, 0.35), (10.2, 0.9))),
    (29, ((5.4, 0.5), (35.7, 0.97), (90.1, 0.6))),
    (30, ((0.3, 0.0), (99.0, 0.0), (99.0, 1.0), (0.3, 1.0))),
)


def _edge_rows() -> list[tuple[int, float, float, float, float]]:
    rows = []
    for number, ring in REGION_VERTICES:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            rows.append((number, x1, y1, x2, y2))
    return rows


EDGES = (
    "height as (select max(prow) + 1 as h from pixels),\nedges as (select n, x1, y1 * h as y1, x2, y2 * h as y2 from height, (values "
    + ", ".join(str(r) for r in _edge_rows())
    + ") v(n, x1, y1, x2, y2))"
)


def _regions(spark: SparkSession, nrow: int) -> DataFrame:
    rows = [(n, n, x1, y1 * nrow, x2, y2 * nrow) for n, x1, y1, x2, y2 in _edge_rows()]
    return spark.createDataFrame(rows, "poly_id long, number int, x1 double, y1 double, x2 double, y2 double")


# Brute force in the oracle: odd number of edges to the right of the cell centre.
INSIDE = """inside as (
  select prow, pcol, n from pixels, edges, height
  where (h - prow - 0.5 >= least(y1, y2)) and (h - prow - 0.5 < greatest(y1, y2))
    and pcol + 0.5 < x1 + (h - prow - 0.5 - y1) * (x2 - x1) / (y2 - y1)
  group by 1, 2, 3 having count(*) % 2 = 1)"""


@query(
    S.sql(
        S.PIXELS, EDGES, INSIDE,
        "select prow, pcol, lc from pixels where (prow, pcol) in (select (prow, pcol) from inside where n in (28, 29))",
    )
)
def cells_in_region(spark: SparkSession, sf: str) -> DataFrame:
    px = S.pixels(spark, sf)
    nrow, _ = raster.grid_shape(px)
    grid = raster.Grid(0.0, float(nrow), 1.0, nrow, 100)
    regions = _regions(spark, nrow).where(F.col("number").isin(28, 29))
    return raster.mask(px.select("prow", "pcol", "lc"), regions, grid)


@query(
    S.sql(
        S.PIXELS, EDGES, INSIDE,
        "select n as number, lc, count(*) as n_cells from inside join pixels using (prow, pcol) where n <> 30 group by 1, 2",
    )
)
def region_attribute_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Cells by region number and class, for the regions picked by attribute."""
    from fieldmark.sources.polygons import subset_polygons

    px = S.pixels(spark, sf)
    nrow, _ = raster.grid_shape(px)
    grid = raster.Grid(0.0, float(nrow), 1.0, nrow, 100)
    spans = raster.region_spans(subset_polygons(_regions(spark, nrow), "number", [28, 29]), grid)
    cells = spans.select("poly_id", "prow", F.explode(F.sequence("first_col", "last_col")).alias("pcol"))
    return (
        px.join(cells, ["prow", "pcol"])
        .groupBy(F.col("poly_id").cast("int").alias("number"), "lc")
        .agg(F.count("*").alias("n_cells"))
    )


@query(S.sql(S.PIXELS, "select prow, pcol, value from pixels where prow >= 5 and pcol between 20 and 69"))
def crop_extent(spark: SparkSession, sf: str) -> DataFrame:
    px = S.pixels(spark, sf).select("prow", "pcol", "value")
    return raster.crop(px, (5, 2**31 - 1), (20, 69))


# --- fixed values: coarse classes of the recode -------------------------------
RECODE = {0: 10, 1: 10, 2: 20, 3: 30}


@query(
    S.sql(
        S.PIXELS,
        "select prow, pcol, case lc when 0 then 10 when 1 then 10 when 2 then 20 when 3 then 30 end as class from pixels",
    )
)
def reclassify(spark: SparkSession, sf: str) -> DataFrame:
    return raster.reclassify(S.pixels(spark, sf).select("prow", "pcol", "lc"), RECODE, "lc").drop("lc")


TARGET_RES = 1.5

BILINEAR = f"""shape as (select max(prow) + 1 as h from pixels),
target as (
  select r.i as trow, c.i as tcol, (r.i + 0.5::double) * {TARGET_RES}::double - 0.5 as sy, (c.i + 0.5::double) * {TARGET_RES}::double - 0.5 as sx, h
  from shape, lateral (select unnest(range(cast(floor(h / {TARGET_RES}::double) as bigint))) as i) r, range({int(100 / TARGET_RES)}) c(i)),
corners as (
  select trow, tcol, least(greatest(floor(sy) + dr, 0), h - 1) as prow, least(greatest(floor(sx) + dc, 0), 99) as pcol,
    (case dr when 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) * (case dc when 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) as w
  from target, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc))"""


@query(
    S.sql(
        S.PIXELS, BILINEAR,
        """select trow, tcol, round(sum(w * value) / sum(w), 6) as value from corners join pixels using (prow, pcol)
        where w > 0 group by 1, 2""",
    )
)
def bilinear_resample(spark: SparkSession, sf: str) -> DataFrame:
    px = S.pixels(spark, sf)
    nrow, _ = raster.grid_shape(px)
    source = raster.Grid(0.0, float(nrow), 1.0, nrow, 100)
    target = raster.Grid(0.0, float(nrow), TARGET_RES, int(nrow / TARGET_RES), int(100 / TARGET_RES))
    return rounded(raster.bilinear_resample(px, source, target), "value")


@query(
    S.sql(
        S.CLIMATE,
        """select site, year, round((temp - avg(temp) over ()) / stddev_samp(temp) over (), 6) as temp_z,
          round((ppt - avg(ppt) over ()) / stddev_samp(ppt) over (), 6) as ppt_z from panel""",
    )
)
def zscore_global(spark: SparkSession, sf: str) -> DataFrame:
    z = scaling.zscore_global(S.panel(spark, sf).select("site", "year", "temp", "ppt"), ["temp", "ppt"])
    return rounded(z.drop("temp", "ppt"), "temp_z", "ppt_z")


@query(
    S.sql(
        S.CLIMATE,
        """long as (select site, year, 'temp' as layer, temp as value from panel union all select site, year, 'ppt', ppt from panel)""",
        """select site, year, layer,
          round((value - avg(value) over w) / stddev_samp(value) over w, 6) as value_z from long window w as (partition by layer, year)""",
    )
)
def zscore_by_layer_year(spark: SparkSession, sf: str) -> DataFrame:
    long = S.panel(spark, sf).select("site", "year", "temp", "ppt").unpivot(["site", "year"], ["temp", "ppt"], "layer", "value")
    return rounded(scaling.zscore_by(long, ["layer", "year"], ["value"]).drop("value"), "value_z")


_CRS = Albers()
_N, _C, _RHO0 = _CRS.cone()
_E = _CRS.e2**0.5


@query(
    S.sql(
        S.CHECKLISTS,
        """angles as (select event_id, sin(radians(raw_latitude::double)) as s, radians(raw_longitude::double + 96.0) as dl from checklists)""",
        f"""polar as (select event_id, dl * {_N!r}::double as theta, {_CRS.radius!r}::double * sqrt({_C!r}::double - {_N!r}::double *
          ({1 - _CRS.e2!r}::double * (s / (1 - {_CRS.e2!r}::double * s * s) - ln((1 - {_E!r}::double * s) / (1 + {_E!r}::double * s)) / (2 * {_E!r}::double)))) / {_N!r}::double as rho
          from angles)""",
        f"""select event_id, round(rho * sin(theta), 3) as x, round({_RHO0!r}::double - rho * cos(theta), 3) as y from polar""",
    )
)
def albers_project(spark: SparkSession, sf: str) -> DataFrame:
    """Metres on an ellipsoidal Albers grid, rounded to millimetres."""
    x, y = albers_xy("raw_longitude", "raw_latitude", _CRS)
    return rounded(S.checklists(spark, sf).select("event_id", x.alias("x"), y.alias("y")), "x", "y", places=3)


#: The pixels as a raster in degrees, and the cell size in metres of its projection.
DEGREES, METRES = (-100.0, 48.0, 0.02), 1500.0
_POLE, (_S2, _S4, _S6) = _CRS._q(1.5707963267948966), _CRS.series()
_AREA = f"({1 - _CRS.e2!r}::double * ({{0}} / (1 - {_CRS.e2!r}::double * {{0}} * {{0}}) - ln((1 - {_E!r}::double * {{0}}) / (1 + {_E!r}::double * {{0}})) / (2 * {_E!r}::double)))"

PROJECTED = f"""shape as (select max(prow) + 1 as h from pixels),
ring as (select unnest(range(h + 1)) as r, 0 as c, h from shape union all select unnest(range(h + 1)), 100, h from shape
  union all select 0, unnest(range(101)), h from shape union all select h, unnest(range(101)), h from shape),
angled as (select h, radians({DEGREES[0]}::double + c * {DEGREES[2]}::double - ({_CRS.lon0}::double)) * {_N!r}::double as theta, sin(radians({DEGREES[1]}::double - r * {DEGREES[2]}::double)) as s from ring),
polar as (select h, theta, {_CRS.radius!r}::double * sqrt({_C!r}::double - {_N!r}::double * {_AREA.format('s')}) / {_N!r}::double as rho from angled),
box as (select h, floor(min(rho * sin(theta)) / {METRES}::double) * {METRES}::double as x0, ceil(max({_RHO0!r}::double - rho * cos(theta)) / {METRES}::double) * {METRES}::double as y1,
  max(rho * sin(theta)) as x1, min({_RHO0!r}::double - rho * cos(theta)) as y0 from polar group by h),
target as (select trow, unnest(range(cast(ceil((x1 - x0) / {METRES}::double) as bigint))) as tcol, x0, y1, h
  from (select *, unnest(range(cast(ceil((y1 - y0) / {METRES}::double) as bigint))) as trow from box)),
centres as (select trow, tcol, h, x0 + (tcol + 0.5::double) * {METRES}::double as x, {_RHO0!r}::double - (y1 - (trow + 0.5::double) * {METRES}::double) as up from target),
areas as (select *, ({_C!r}::double - (x * x + up * up) * {_N**2!r}::double / {_CRS.radius**2!r}::double) / {_N!r}::double as q from centres),
authalic as (select *, asin(q / {_POLE!r}::double) as b from areas),
near as (select *, b + {_S2!r}::double * sin(2 * b) + {_S4!r}::double * sin(4 * b) + {_S6!r}::double * sin(6 * b) as f from authalic),
located as (select trow, tcol, h, {_CRS.lon0}::double + degrees(atan2(x, up) / {_N!r}::double) as lon,
  degrees(f + (q - {_AREA.format('sin(f)')}) * pow(1 - {_CRS.e2!r}::double * sin(f) * sin(f), 2) / (2 * {1 - _CRS.e2!r}::double * cos(f))) as lat from near),
wanted as (select trow, tcol, h, (lon - ({DEGREES[0]}::double)) / {DEGREES[2]}::double - 0.5 as sx, ({DEGREES[1]}::double - lat) / {DEGREES[2]}::double - 0.5 as sy from located),
corners as (select trow, tcol, least(greatest(floor(sy) + dr, 0), h - 1) as prow, least(greatest(floor(sx) + dc, 0), 99) as pcol,
    (case dr when 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) * (case dc when 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) as w
  from wanted, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc) where sx between -0.5 and 99.5 and sy between -0.5 and h - 0.5)"""


@query(S.sql(S.PIXELS, PROJECTED, "select trow, tcol, round(sum(w * value) / sum(w), 5) as value from corners join pixels using (prow, pcol) where w > 0 group by 1, 2"))
def project_raster(spark: SparkSession, sf: str) -> DataFrame:
    """The pixels as a raster in degrees, projected to an ellipsoidal Albers grid."""
    px = S.pixels(spark, sf).select("prow", "pcol", "value")
    nrow, _ = raster.grid_shape(px)
    out, _ = raster.project_raster(px, raster.Grid(*DEGREES, nrow, 100), _CRS, METRES)
    return rounded(out, "value", places=5)


#: Range maps: the suppliers of a nation are the vertices of its polygon, spread over the survey's extent.
SPOTS = """spots as (select s_nationkey as poly_id, row_number() over (partition by s_nationkey order by s_suppkey) as seq, count(*) over (partition by s_nationkey) as n,
    -100 + (s_suppkey * 37 % 300) * 0.1::double as x, 25 + (s_suppkey * 53 % 250) * 0.1::double as y from supplier),
ranges as (select a.poly_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from spots a join spots b on a.poly_id = b.poly_id and b.seq = a.seq % a.n + 1),
chosen as (select * from ranges where poly_id % 3 in (1, 2) and 'Brand#' || (poly_id + 1) in (select species from species_info where mig_status <> 'Resident'))"""


@query(
    S.sql(
        S.CHECKLISTS, S.SPECIES_INFO, SPOTS,
        "spotted as (select raw_longitude::double + 0.03 as x, raw_latitude::double + 0.04 as y, count(*) as n from checklists group by 1, 2)",
        """hit as (select x, y, n, poly_id from spotted, chosen where y >= least(y1, y2) and y < greatest(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
          group by 1, 2, 3, 4 having count(*) % 2 = 1)""",
        "select 'Brand#' || (poly_id + 1) as species, count(*) as n_places, sum(n)::bigint as n_lists from hit group by 1",
    )
)
def range_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Checklists inside the range maps of the migrants, resident and breeding seasons only."""
    from fieldmark.operators import ranges
    from fieldmark.sources import polygons

    vertices = S.table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("poly_id"), F.lit(1).alias("ring"), F.col("s_suppkey").alias("seq"),
        (-100 + (F.col("s_suppkey") * 37 % 300) * 0.1).alias("x"), (25 + (F.col("s_suppkey") * 53 % 250) * 0.1).alias("y"),
    )
    edges = polygons.edges_from_vertices(vertices).withColumns({"SCINAME": F.format_string("Brand#%d", F.col("poly_id") + 1), "SEASONAL": (F.col("poly_id") % 3).cast("int")})
    migrants = S.species_info(spark, sf).where("mig_status <> 'Resident'").select(F.col("species").alias("scientific_name"))
    chosen = polygons.subset_by_species(edges, migrants, [1, 2])
    spotted = S.checklists(spark, sf).select((F.col("raw_longitude").cast("double") + 0.03).alias("x"), (F.col("raw_latitude").cast("double") + 0.04).alias("y"))
    found = ranges.points_in_polygons(spotted, chosen, ranges.Square(-101.0, 20.0, 32.0), levels=6)
    counts = spotted.groupBy("x", "y").agg(F.count("*").alias("n"))
    return found.join(counts, ["x", "y"]).groupBy(F.format_string("Brand#%d", F.col("poly_id") + 1).alias("species")).agg(F.count("*").alias("n_places"), F.sum("n").alias("n_lists"))
