import datetime
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import columns as C
from fieldmark.functions.projection import Albers, albers_xy


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_presence_from_file_text(spark):
    rows = [(v,) for v in ("X", "3", "0", "0.0", "?", None, "NA", "")]
    got = values(spark, rows, "v string", C.presence(C.tokens_to_null("v")))
    assert got == [1, 1, 0, 0, 0, 0, 0, 0]


def test_covariate_sentinels(spark):
    rows = [(v,) for v in ("-9999", "-9999.0000", "?", "12.5", "NaN")]
    assert values(spark, rows, "v string", C.sentinel_number("v")) == [None, None, None, 12.5, None]


def test_day_of_year(spark):
    got = values(spark, [(2008, 122), (2009, 121)], "y int, d int", C.visit_date("y", "d"))
    assert got == [datetime.date(2008, 5, 1), datetime.date(2009, 5, 1)]


@pytest.mark.parametrize("year", [2008, 2009])
def test_fortnights_by_calendar_offset(spark, year):
    offsets = [-1, 0, 13, 14, 26, 27, 91, 92]
    rows = [(datetime.date(year, 5, 1) + datetime.timedelta(days=o),) for o in offsets]
    assert values(spark, rows, "d date", C.fortnight("d")) == [None, 0, 0, 1, 1, 2, 6, None]


def test_every_day_of_the_season_has_a_fortnight(spark):
    rows = [(datetime.date(2010, 5, 1) + datetime.timedelta(days=o),) for o in range(92)]
    got = values(spark, rows, "d date", C.fortnight("d"))
    assert [got.count(k) for k in range(7)] == [14, 13, 13, 13, 13, 13, 13]


def test_rounding_half_away_from_zero(spark):
    rows = [(Decimal(v),) for v in ("1.005", "2.345", "-2.345")]
    got = values(spark, rows, "v decimal(12,6)", C.rounded_coordinate("v"))
    assert got == [Decimal("1.01"), Decimal("2.35"), Decimal("-2.35")]


def test_place_key(spark):
    rows = [(Decimal("40.10"), Decimal("-75.00"))]
    assert values(spark, rows, "a decimal(9,2), b decimal(9,2)", C.place_key("a", "b")) == ["40.10_-75.00"]


def test_draw_names(spark):
    rows = [(v,) for v in ("wp[1,2]", "betap[7,12]", "n.occ[11,3]", "deviance")]
    assert values(spark, rows, "v string", C.indices_of("v")) == [[1, 2], [7, 12], [11, 3], None]
    assert values(spark, rows, "v string", C.root_of("v")) == ["wp", "betap", "n.occ", "deviance"]
    assert values(spark, rows, "v string", C.index_of("v", 2)) == [2, 12, 3, None]


def test_names(spark):
    assert values(spark, [("Vireo griseus",)], "v string", C.underscored("v")) == ["Vireo_griseus"]
    assert values(spark, [("Vireo_griseus",)], "v string", C.spaced("v")) == ["Vireo griseus"]
    assert values(spark, [("a.b",), ("a",)], "v string", C.dotted_part("v", 2)) == ["b", None]


def test_nan_and_infinity_are_missing(spark):
    rows = [(math.nan,), (math.inf,), (-math.inf,), (2.0,), (None,)]
    assert values(spark, rows, "v double", C.finite("v")) == [None, None, None, 2.0, None]


def test_logit_round_trip(spark):
    rows = [(v,) for v in (0.001, 0.5, 0.93)]
    got = values(spark, rows, "p double", C.inv_logit(C.logit("p")))
    assert got == pytest.approx([0.001, 0.5, 0.93])


def test_importance_mask(spark):
    rows = [(0.5,), (0.51,)]
    assert values(spark, rows, "m double", C.important("m")) == [None, 1]


def test_albers_published_examples(spark):
    """Worked values of the map-projection manual: unit sphere and the 1866 ellipsoid."""
    df = spark.createDataFrame([(-75.0, 35.0)], "lon double, lat double")
    sphere = Albers(radius=1.0, flattening=0.0)
    x, y = df.select(*albers_xy("lon", "lat", sphere)).first()
    assert (x, y) == (pytest.approx(0.2952720, abs=1e-7), pytest.approx(0.2416774, abs=1e-7))
    e2 = 0.00676866
    clarke = Albers(radius=6378206.4, flattening=1 - math.sqrt(1 - e2))
    x, y = df.select(*albers_xy("lon", "lat", clarke)).first()
    assert (x, y) == (pytest.approx(1885472.7, abs=0.2), pytest.approx(1535925.0, abs=0.2))


def test_constants_are_expressions(spark):
    assert values(spark, [(2006,), (2011,)], "y int", C.year_index("y")) == [1, 6]
    low, high = C.bounds("m", "s")
    assert values(spark, [(1.0, 0.25)], "m double, s double", F.array(low, high)) == [[0.75, 1.25]]
