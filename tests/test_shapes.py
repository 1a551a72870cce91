"""Rings, projections and line matching."""

import pytest
from pyspark.sql import functions as F

from geoloom.functions import shapes
from geoloom.operators import routes


def test_hull_and_simplify():
    assert shapes.hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (0, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert shapes.simplified([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1) == [(0, 0), (2, 0), (2, 2)]
    assert shapes.cleaned([(0, 0), (0, 0), (1, 0), (1, 1), (0, 0)]) == [(0, 0), (1, 0), (1, 1), (0, 0)] and shapes.cleaned([(0, 0), (1, 1)]) == []
    assert shapes.clipped([(-1, 0.5), (2, 0.5), (2, 5)], 0, 0, 1, 1) == [[(0, 0.5), (1, 0.5)]]


def test_hulls_by_group(spark):
    df = spark.createDataFrame([("a", float(x), float(y)) for x in range(4) for y in range(4)] + [("b", 1.0, 1.0)], "g string, x double, y double").repartition(3)
    got = {r.g: (r.n, len(r.ring)) for r in shapes.hulls(df, ["g"]).collect()}
    assert got == {"a": (16, 4), "b": (1, 1)}


def test_projections(spark):
    lat, lon = shapes.lambert_inverse(F.lit(200000.0), F.lit(750000.0), 41.716667, 42.683333, 41.0, -71.5, 200000.0, 750000.0)
    r = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert r.lat == pytest.approx(41.0, abs=1e-6) and r.lon == pytest.approx(-71.5, abs=1e-9)
    lat, lon = shapes.albers_inverse(F.lit(0.0), F.lit(0.0), 29.5, 45.5, 37.5, -96.0)
    r = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert r.lat == pytest.approx(37.5, abs=1e-9) and r.lon == -96


def test_streamline_stays_on_a_parallel():
    path = shapes.streamline(lambda x, y: 10.0, lambda x, y: 0.0, 179.9, 0.0, 20, 3600)
    assert len(path) == 21 and all(y == 0 for _, y in path) and path[-1][0] < -170


def test_flows_on_roads(spark):
    line = lambda y, n=4: [{"lon": 0.001 * i, "lat": y} for i in range(n)]
    road = "road string, oneway boolean, coords array<struct<lon:double,lat:double>>"
    flow = "flow string, level double, closure boolean, coords array<struct<lon:double,lat:double>>"
    roads = spark.createDataFrame([("r", False, line(0.0)), ("far", False, line(0.01))], road)
    flows = spark.createDataFrame([("a", 0.2, False, line(0.0001, 2)), ("b", 0.4, False, line(0.0001)[1:3]), ("c", 0.9, True, line(0.0001)[2:4]), ("across", 0.1, False, [{"lon": 0.0015, "lat": -0.0001}, {"lon": 0.0015, "lat": 0.0001}])], flow)
    got = routes.matched_flows(roads, flows).collect()
    assert [(r.road, r.level, r.closed) for r in got] == [("r", 0.4, True)]
    back = spark.createDataFrame([("r", True, line(0.0)[::-1])], road)
    assert routes.matched_flows(back, flows).count() == 0
