"""Lookups and contracts on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom.sources import lookups, tabular


def rows(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_geocoded(spark):
    a = {"results": [{"formatted_address": "1 Main St", "address_components": [{"long_name": "Salem", "types": ["locality"]}, {"long_name": "MA", "types": ["administrative_area_level_1"]}]}]}
    b = {"display_name": "Here", "address": {"town": "Lynn", "country": "US"}}
    got = [tuple(r) for r in lookups.geocoded(rows(spark, a, b, "{}")).collect()]
    assert got == [("1 Main St", "Salem", "MA", None), ("Here", "Lynn", None, "US"), (None, None, None, None)]


def test_embedded(spark):
    page = '<script>var _pageData = "[1,{\\"a\\":\\"x\\"}]";</script>'
    got = lookups.embedded(rows(spark, page, "nothing"), "_pageData").select(F.try_variant_get("data", "$[1].a", "string").alias("a")).collect()
    assert [r.a for r in got] == ["x", None]


def test_storms(spark):
    s = {"id": "a", "name": "A", "wind": 50, "track": [[1, 2], [3, 4]]}
    assert lookups.storms(rows(spark, {"storms": [s]})).count() == 1
    for bad in ([s, s], [{**s, "track": [[181, 0]]}], [{**s, "wind": -1}], [{**s, "id": str(i)} for i in range(33)]):
        with pytest.raises(ValueError):
            lookups.storms(rows(spark, {"storms": bad}))


def test_looked_up(spark):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "id int, lat double, lon double")
    cache = spark.createDataFrame([(3, 99.0)], "id int, value double")
    got = {r.id: r.value for r in lookups.looked_up(points, lambda ps: [lat * 2 for lat, _ in ps], cache=cache).collect()}
    assert got[3] == 99 and got[4] == 8 and len(got) == 10

    def fails(ps):
        raise OSError

    with pytest.raises(ValueError):
        lookups.looked_up(points, fails)


def test_enriched_and_layers(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    cache = spark.createDataFrame([("a", True, 0, "A"), ("b", False, 10, None), ("c", False, -(10**9), None)], "k string, found boolean, at_ms long, name string")
    out, ask = lookups.enriched(df, cache, "k", 1000)
    assert sorted((r.k, r.name) for r in out.collect()) == [("a", "A"), ("b", None), ("c", None), ("d", None)] and sorted(r.k for r in ask.collect()) == ["c", "d"]
    for name in ("../x", "Nope", "missing-layer"):
        with pytest.raises(ValueError):
            lookups.layer_table(spark, name)


def test_crime_table(spark):
    raw = spark.createDataFrame([(2000, 1, "ALABAMA", "Mobile", "1,200"), (2000, 2, None, "Selma", "-"), (2000, 3, "ALASKA", "Nome", ""), (2000, 4, None, "", "5")], "year int, line int, c0 string, c1 string, c2 string")
    got = sorted((r.state, r.city, r.c2) for r in tabular.read_table8(raw).collect())
    assert got == [("ALABAMA", "Mobile", 1200), ("ALABAMA", "Selma", 0), ("ALASKA", "Nome", None)]


def test_shares_unions_and_lines(spark):
    from pyspark.sql import functions as F

    from geoloom.functions import records
    from geoloom.operators import aggregates, joins, layers, routes
    from geoloom.streaming import live

    packs = spark.createDataFrame([("a", k) for k in range(9)] + [("b", 0), ("c", 5), ("c", 7)], "pack string, k int")
    got = [(r.pack, r.k) for r in layers.fair_share(packs, "pack", "k", 8).orderBy("turn", "pack").collect()]
    assert got == [("a", 0), ("b", 0), ("c", 5), ("a", 1), ("c", 7), ("a", 2), ("a", 3), ("a", 4)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert {tuple(r) for r in joins.priority_union([("x", ids(1, 2, 2)), ("y", ids(2, 3)), ("z", ids(1, 4))], "id").collect()} == {(1, "x"), (2, "x"), (3, "y"), (4, "z")}
    areas = spark.createDataFrame([("m", "A", 1.0), ("m", "B", 3.0), ("m", None, 9.0), ("n", "Z", 1.0), ("o", "A", 0.0)], "city string, grade string, area double")
    assert {r.city: (r.areas, r.A, r.B) for r in aggregates.grade_shares(areas, "city", "grade", ["A", "B"], "area").collect()} == {"m": (2, 25.0, 75.0), "o": (1, None, None)}
    lines = spark.createDataFrame([(1, 1, 10.0), (1, 2, 0.0), (1, 3, 20.0), (2, 1, 5.0)], "line int, k int, km double")
    at = lambda km: {r.line: (r.segment, r.fraction) for r in routes.along_line(lines, "line", ["k"], "km", km).collect()}
    assert at(10.0) == {1: (1, 1.0)} and at(15.0) == {1: (3, 0.25)} and at(0.0) == {1: (1, 0.0), 2: (1, 0.0)}
    polls = spark.createDataFrame([("s", 1, 1, True), ("s", 1, 2, True), ("s", 2, 1, False), ("s", 2, 2, True), ("s", None, 1, True), ("t", 1, 1, True)], "source string, key int, seq int, ok boolean")
    assert {r.source: (r.accepted, r.rejected, r.complete) for r in live.admission(polls, "source", "key", F.col("ok"), "seq").collect()} == {"s": (1, 4, False), "t": (1, 0, True)}
    planes = spark.createDataFrame([(" xx1 ", None), ("K35R", None), ("EC20", None), (None, "A7"), ("??", None)], "code string, cat string")
    table = spark.createDataFrame([("XX1", "glider"), ("XX1", "uav")], "code string, class string")
    assert {(r.code, r["class"]) for r in records.classified(planes, table, "code", "cat").collect()} == {(" xx1 ", "glider"), ("K35R", "widebody"), ("EC20", "helicopter"), (None, "helicopter"), ("??", "airliner")}
