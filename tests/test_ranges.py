"""Points in polygons against ray casting, whatever the depth of the cover."""

import random

import pytest

from fieldmark.operators import ranges

SQUARE = ranges.Square(0.0, 0.0, 16.0)


def ring(number, corners):
    return [(number, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]


def made_up(seed=3):
    r = random.Random(seed)
    edges = ring(1, [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)]) + ring(1, [(3.0, 3.0), (5.0, 3.0), (5.0, 5.0), (3.0, 5.0)])  # a hole
    edges += ring(2, [(r.uniform(0, 16), r.uniform(0, 16)) for _ in range(9)])  # crosses itself
    edges += ring(3, [(-5.0, 12.0), (30.0, 12.0), (30.0, 14.0), (-5.0, 14.0)])  # reaches out of the square
    edges += ring(4, [(12.0, 2.0), (12.01, 2.0), (12.01, 2.01), (12.0, 2.01)])  # smaller than any cell
    points = [(r.uniform(-1, 17), r.uniform(-1, 17)) for _ in range(400)] + [(12.005, 2.005), (4.0, 4.0), (1.0, 1.0), (9.0, 9.0), (8.0, 8.0), (16.0, 13.0), (0.0, 13.0)]
    return edges, points


def cast(edges, points):
    found = set()
    for x, y in points:
        if not (0 <= x <= 16 and 0 <= y <= 16):
            continue
        for number in {e[0] for e in edges}:
            right = sum(min(b, d) <= y < max(b, d) and x < a + (y - b) * (c - a) / (d - b) for n, a, b, c, d in edges if n == number and b != d)
            if right % 2:
                found.add((x, y, number))
    return found


@pytest.mark.parametrize("levels", [1, 4])
def test_points_match_ray_casting(spark, levels):
    edges, points = made_up()
    e = spark.createDataFrame(edges, "poly_id long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([*points, *points[:20], (None, 1.0)], "x double, y double")
    rows = [tuple(r) for r in ranges.points_in_polygons(p, e, SQUARE, levels).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == cast(edges, points)


def test_no_polygons_no_rows(spark):
    e = spark.createDataFrame([], "poly_id long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    assert ranges.points_in_polygons(p, e, SQUARE, 2).count() == 0
