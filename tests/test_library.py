"""The library on small literal inputs with known results."""

import bz2
import gzip
import io
import json
import lzma
import math
import tarfile
import zipfile

import pandas as pd
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import dates, geo, records, text
from geoloom.operators import aggregates, grids, joins, layers, routes, scratch, stats
from geoloom.plans import commands, merge, report
from geoloom.plans.joining import squares
from geoloom.sources import feeds, sinks, tabular
from geoloom.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


AREAS = [("25025000100", 30.5, 12.0, "C", -71.1, 42.3), ("25025000200", None, 20.0, "D", -71.0, 42.3), ("44007000100", 18.0, 15.0, None, -71.4, 41.8)]
COUNTIES = [("06037", 3300000), ("12086", 1470000), ("25025", 235000), ("25017", 400000), ("48201", 1300000), ("30001", None)]


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame(AREAS, "geoid string, fb24 double, pov double, holc_grade string, lon double, lat double")


def test_layer(areas):
    assert layers.pruned(areas, state="25").count() == 2
    assert [r.geoid for r in layers.pruned(areas, view=(-71.5, 41.5, -71.2, 42)).collect()] == ["44007000100"]
    with pytest.raises(ValueError):
        layers.pruned(areas, chunks=121)
    assert layers.kinds(areas)["holc_grade"] == "string" and layers.kinds(areas)["pov"] == "numeric"
    assert layers.legal_names(["My Value", "my-value", "2020 x"]) == {"My Value": "my_value", "my-value": "my_value_2", "2020 x": "v2020_x"}
    assert layers.rows(areas, {"fb24": "foreign_born_share"}, ["geoid", "fb24", "lon"]).columns == ["geoid", "foreign_born_share", "lon"]


def test_feature_lines(spark):
    lines = spark.createDataFrame([('{"id":"a","properties":{"v":1.5}}\r',), ("   ",), ('{"id":"b","properties":{}}',)], "value string")
    got = layers.features(lines, "id string, properties struct<v:double>").collect()
    assert [(r.id, r.properties.v) for r in got] == [("a", 1.5), ("b", None)]


def test_report(spark):
    df = spark.createDataFrame(COUNTIES, "geoid string, fbn24 long")
    plan = report.planned({"rank_by": "fbn24", "limit": 3}, df.columns)
    got = report.ranked(df, plan).orderBy("rank").collect()
    assert plan.ok and [r.geoid for r in got] == ["06037", "12086", "48201"] and got[0].eligible == 5
    assert report.planned({"rank_by": "nope", "limit": 900}, df.columns).problems == ["unknown column: nope"]
    assert report.planned({"limit": 900}, df.columns).limit == 500
    header, body = report.table(report.ranked(df, plan), plan, {"fbn24": "count"})
    assert body[0] == ["1", "06037", "3,300,000"]
    assert report.csv(["a", "b"], [["1,0", "x"]]) == '﻿a,b\r\n"1,0",x\r\n'.encode()
    assert report.shown(None, "count") == "—" and report.shown(12.34, "percent") == "12.3%"


def test_merge(spark):
    a = spark.createDataFrame([("01", 1), ("02", 2), ("03", 3), (None, 4)], "k string, x int")
    b = spark.createDataFrame([("01", 5), ("01", 6), ("04", 7)], "k string, y int")
    assert tuple(joins.merge_report(a, b, "k").first()) == ("1:m", 1, 3, 1)
    assert joins.merge(a, b, "k").count() == 5 and joins.merge(a, b, "k", "inner").count() == 2 and joins.merge(a, b, "k", "outer").count() == 6
    assert joins.suggested_key(a, b) == ("k", "k")
    catalog = merge.Catalog({"tract:poverty": spark.createDataFrame([("01", 9.0)], "geoid string, poverty double")})
    user = a.withColumnRenamed("k", "geoid")
    out = merge.run(spark, user, merge.MergePlan(attach=["poverty"]), catalog)
    assert out.notes == ["tract:poverty: 1 of 4 rows"] and out.data.count() == 4
    with pytest.raises(ValueError):
        merge.run(spark, user, merge.MergePlan(attach=["nothing"]), catalog)
    counted = merge.run(spark, spark.createDataFrame([("01001000100",), ("01003000100",)], "geoid string"), merge.MergePlan(count="county"), catalog, spark.createDataFrame([("01001",), ("01005",)], "geoid string"))
    assert sorted(map(tuple, counted.data.collect())) == [("01001", 1), ("01005", 0)]


def test_apportion(spark):
    x = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "y", 0.0), ("b", "z", 0.0)], "f string, t string, w double")
    v = spark.createDataFrame([("a", 100.0, 40.0), ("b", 10.0, 2.0)], "f string, p double, q double")
    got = {r.t: (r.p, r.q) for r in aggregates.apportion(x, v, "f", "t", "w", ["p", "q"]).collect()}
    assert got == {"x": (75, 30), "y": (30, 11), "z": (5, 1)}


def test_dissimilarity(spark):
    rows = [("17031", 600, 0)] * 2 + [("17031", 0, 700)] * 3 + [("17043", 2000, 2000)] * 2
    got = {r.county: (r.tracts, r.d) for r in aggregates.dissimilarity(spark.createDataFrame(rows, "county string, a long, b long"), ["county"], "a", "b").collect()}
    assert got["17031"] == (5, pytest.approx(100)) and got["17043"] == (2, None)


def test_block_means(spark):
    df = spark.createDataFrame([(0.82, 0.012), (0.84, 0.016)], "x double, se double")
    r = df.agg(*aggregates.mean_with_error("x", "se")).first()
    assert r["mean"] == pytest.approx(0.83) and r["se"] == pytest.approx(0.01)
    assert df.withColumn("se", F.lit(None).cast("double")).agg(*aggregates.mean_with_error("x", "se")).first()["se"] is None


def test_contiguity_and_moran(spark):
    grid = squares(spark, 3)
    n = {r.i: r.n for r in joins.contiguity(grid, "id").groupBy("i").agg(F.count("j").alias("n")).collect()}
    assert n[4] == 8 and n[0] == 3
    rook = joins.contiguity(grid, "id", rook=True)
    assert sorted(r.j for r in rook.where("i = 0").collect()) == [1, 3] and rook.where("i = 4").count() == 4
    board = spark.range(16).select("id", F.when((F.col("id") % 4 + F.floor(F.col("id") / 4)) % 2 == 0, 1.0).otherwise(0.0).alias("value"))
    r = stats.morans_i(board, joins.contiguity(squares(spark, 4), "id", rook=True)).first()
    assert r["i"] == pytest.approx(-1) and r["expected"] == pytest.approx(-1 / 15) and r["islands"] == 0
    slope = spark.range(100).select("id", (F.col("id") % 10).cast("double").alias("value"))
    p = stats.permuted_i(slope, joins.contiguity(squares(spark, 10), "id", rook=True), 199).first()
    assert p["i"] > 0.6 and p["z"] > 5 and p["p"] == pytest.approx(1 / 200)


def test_least_squares(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1 + (0.1 if x % 2 else -0.1)) for x in range(50)], "x double, y double")
    m = stats.least_squares(df, "y", ["x"]).set_index("term")
    assert m.coef["x"] == pytest.approx(2, abs=0.01) and m.coef["_cons"] == pytest.approx(1, abs=0.1)
    assert stats.least_squares(df, "y", ["x"], robust=True).se.gt(0).all()


def test_count_models_of_two_groups(spark):
    """With one indicator the fitted means are those of its groups: log of means for Poisson, of odds for logit."""
    rows = [(0, y, int(y > 2)) for y in (1, 2, 3, 4, 0)] + [(1, y, int(y > 2)) for y in (4, 6, 8, 2)]
    df = spark.createDataFrame(rows, "x int, y int, hit int")
    fit, _ = stats.generalised(df, "y", ["x"], "poisson")
    got = dict(zip(fit["term"], fit["coef"]))
    assert abs(got["_cons"] - math.log(2)) < 1e-6 and abs(got["x"] - math.log(5 / 2)) < 1e-6
    fit, _ = stats.generalised(df, "hit", ["x"], "binomial")
    got = dict(zip(fit["term"], fit["coef"]))
    assert abs(got["_cons"] - math.log(2 / 3)) < 1e-6 and abs(got["x"] - (math.log(3) - math.log(2 / 3))) < 1e-6


def test_plausible_routes(spark):
    """New York to London: on the way, far off it, climbing in the middle, at an end."""
    rows = [(52.0, -40.0, 0.0), (20.0, -40.0, 0.0), (52.0, -40.0, 20.0), (40.7, -73.0, 20.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, climb double")
    got = [r[0] for r in df.select(routes.plausible("lat", "lon", "climb", F.lit(40.6), F.lit(-73.8), F.lit(51.5), F.lit(-0.5))).collect()]
    assert got == [True, False, False, True]


def test_permutations_of_noise(spark):
    """Values without a pattern are not significant, and both ways of permuting say about the same."""
    import random

    r = random.Random(1)
    shapes_ = squares(spark, 12)
    edges = joins.contiguity(shapes_, "id", rook=True)
    noise = spark.createDataFrame([(i, r.random()) for i in range(144)], "id long, value double")
    p = stats.permuted_i(noise, edges, 199).first()
    assert p.p > 0.05 and abs(p.z) < 2
    slope = spark.createDataFrame([(i, float(i % 12)) for i in range(144)], "id long, value double")
    a = stats.permuted_i(slope, edges, 199).first()
    held, stats.MOST_VECTOR = stats.MOST_VECTOR, 10
    try:
        b = stats.permuted_i(slope, edges, 199).first()
    finally:
        stats.MOST_VECTOR = held
    assert a.p == b.p == 1 / 200 and a.z > 5 and b.z > 5


def test_nearest_agrees(spark):
    a = spark.createDataFrame([(i, *p) for i, p in enumerate([(89.5, 10.0), (-10.0, 179.9), (0.0, 0.0), (48.0, 2.0), (-89.9, -170.0)])], "id int, lat double, lon double")
    b = spark.createDataFrame([(i, *p) for i, p in enumerate([(89.0, -170.0), (-10.0, -179.8), (1.0, 1.0), (40.0, -100.0)])], "site int, lat double, lon double")
    few = sorted((r.id, r.site, round(r.km, 6)) for r in joins.nearest(a, b, "id", "site").collect())
    many = sorted((r.id, r.site, round(r.km, 6)) for r in joins.nearest(a, b, "id", "site", 100.0).collect())
    assert few == many and [x[1] for x in few[:3]] == [0, 1, 2]


def test_nearest_is_the_nearest(spark):
    """Against all pairs: places near and far from a cluster, at the poles and across the dateline; no places at all."""
    import random

    r = random.Random(3)
    a = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(300)] + [(900, 90.0, 0.0), (901, -90.0, 0.0), (902, 10.0, 180.0), (903, 10.0, -180.0), (904, None, 1.0)]
    b = [(i, r.gauss(10, 1), r.gauss(179, 1) if i % 2 else r.gauss(2, 1)) for i in range(60)] + [(99, -89.5, 10.0)]
    b = [(i, y, (x + 180) % 360 - 180) for i, y, x in b]
    km = lambda p, q: 2 * geo.MEAN_KM * math.asin(math.sqrt(min(1, math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2)))
    want = sorted((i, round(min(km(p, q) for _, *q in b), 6)) for i, *p in a if p[0] is not None)
    left, right = spark.createDataFrame(a, "id int, lat double, lon double"), spark.createDataFrame(b, "site int, lat double, lon double")
    for first in (None, 50.0, 5000.0):
        assert sorted((x.id, round(x.km, 6)) for x in joins.nearest(left, right, "id", "site", first).collect()) == want
    assert joins.nearest(left, right.limit(0), "id", "site").count() == 0


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "v int, n int").repartition(5)
    got = {r.v: r.upto for r in scratch.prefix_sums(df, "v", "n").collect()}
    total, n = 0, {i * 7 % 101: i for i in range(101)}
    for v in sorted(n):
        total += n[v]
        assert got[v] == total


def test_history_of_a_table_is_that_of_each_key(spark):
    """The fold over sorted fixes equals one ring and track for each key."""
    import random

    r = random.Random(5)
    rows = [(k, 1000 * r.randrange(4000), 10 + r.random() / 100, 20 + r.random() / 100, r.choice(["a", "b"])) for k in range(7) for _ in range(150)] + [(None, 1, 1.0, 1.0, "a")]
    df = spark.createDataFrame(rows, "key long, ms long, lat double, lon double, trip string").repartition(3)
    want = []
    for k in range(7):
        ring, track, motion = live.Ring(), live.Track(), "wait"
        for _, *fix in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:4]):
            motion = live._step(ring, track, *fix)
        want.append((k, ring.fixes[-1][0], len(ring.fixes), len(ring.epochs), ring.truncated, motion))
    assert sorted(map(tuple, live.history_batch(df).collect())) == want


def test_dates_refuse_what_is_none(spark):
    df = spark.createDataFrame([("PT1.5H", "12345"), ("+PT5S", "45"), ("-P1DT0.5M", "0"), ("P", "x"), ("PT", "2400")], "d string, t string")
    got = [tuple(r) for r in df.select(dates.iso_duration("d"), F.date_format(dates.acquired(F.lit("2024-01-02"), "t"), "HH:mm")).collect()]
    assert got == [(5400.0, None), (None, "00:45"), (-86430.0, "00:00"), (0.0, None), (0.0, None)]


def test_places_of_cases(spark):
    texts = ["Anderson, Robert, 18 years old, killed with blow of baseball bat, 211 W. Polk St., by John McQuade, who escaped. W. 12th St. Station.", "Fisher, Peter, 52 yrs., died home 28th St. and Maplewood Av., from assault committed Feb. 11.", "Smith, John, of 5017 Rockwell St., shot dead in saloon, 2449 State St., by a stranger.", "Shot by Officer Black, of 35th St. Station.", "Fatally shot during riot at Kensington."]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    assert [r.p for r in df.select("i", text.crime_place("x").alias("p")).orderBy("i").collect()] == ["211 W. Polk St.", "28th St. and Maplewood Av.", "2449 State St.", None, None]
    corner = spark.createDataFrame([("12th & State sts.",), ("211 W. Polk St.",)], "x string").select(text.street_corner("x").alias("c"), text.street_address("x").alias("a")).collect()
    assert tuple(corner[0].c) == ("12TH", "STATE") and corner[0].a is None and corner[1].c is None and tuple(corner[1].a) == (211, "W", "POLK", "ST")


def test_radio_codes_and_heights(spark):
    df = spark.createDataFrame([("40 ft", {"building:levels": "2", "roof:height": "1,5 m"}), ("0", {"height": "12"}), (None, {})], "h string, tags map<string,string>")
    got = [tuple(r) for r in df.select(F.round(records.metres("h"), 3), F.round(records.building_height("tags"), 3)).collect()]
    assert got == [(12.192, 8.1), (None, 12.0), (None, None)]


@settings(max_examples=25, deadline=None)
@given(st.floats(-89, 89), st.floats(-180, 179), st.floats(-89, 89), st.floats(-180, 179))
def test_distance_is_symmetric(spark, a, b, c, d):
    p = [F.lit(x) for x in (a, b, c, d)]
    there, back = (one(spark, geo.haversine(*q)) for q in (p, p[2:] + p[:2]))
    assert there == pytest.approx(back, abs=1e-6) and 0 <= there <= math.pi * geo.KM + 1e-6


def test_geometry(spark):
    lat, lon = geo.destination(F.lit(0.0), F.lit(179.5), F.lit(90.0), F.lit(111194.9), geo.ROUND_M)
    assert one(spark, lon) == pytest.approx(-179.5, abs=1e-3) and one(spark, lat) == pytest.approx(0, abs=1e-6)
    assert one(spark, geo.compass(F.lit(350.0))) == "N" and one(spark, geo.compass(F.lit(45.0))) == "NE"
    assert one(spark, geo.in_box(F.lit(0.0), F.lit(-179.0), F.lit(170), F.lit(-5), F.lit(-170), F.lit(5)))
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))))
    assert one(spark, geo.ring_area(ring)) == 8 and [one(spark, c) for c in geo.ring_centroid(ring)] == [2, 1]
    assert one(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), ring)) and not one(spark, geo.in_ring(F.lit(5.0), F.lit(1.0), ring))
    assert one(spark, geo.cross_track(F.lit(1.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10.0))) == pytest.approx(-111.19, abs=0.1)
    assert [round(one(spark, c), 6) for c in geo.between(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.5))] == [0, 45]
    assert one(spark, geo.tile_lat(geo.tile_y(F.lit(0.0), 4), 4)) == pytest.approx(0)


def test_names(spark):
    assert one(spark, text.place_name(F.lit("Saint Paul's & Mount Airy (city)"))) == "st pauls and mt airy"
    assert set(one(spark, text.name_candidates(F.lit("Macon-Bibb City")))) >= {"macon-bibb", "macon", "bibb", "macon-bibb city"}
    assert one(spark, text.fnv1a(F.lit("ab"))) == 1294271946
    assert one(spark, text.byte_prefix(F.lit("aé€x"), 4)) == "aé" and one(spark, text.column_index(F.lit("BC7"))) == 54
    assert [tuple(x) for x in one(spark, text.index_list(F.lit("0:12.1,2:2.3")))] == [(0, 12.1), (2, 2.3)]
    assert one(spark, text.without_suffix(F.lit("Athens-Clarke unified government (balance)"))).startswith("Athens")
    assert one(spark, text.coordinates(F.lit("48.85, 2.35")))["lon"] == 2.35 and one(spark, text.coordinates(F.lit("99 20"))) is None
    for url, ok in (("https://radio.example.org/x", True), ("http://10.0.0.1/", False), ("http://8.8.8.8:80/", True), ("ftp://a.b", False), ("http://localhost/", False), ("http://172.20.1.1", False)):
        assert one(spark, text.public_host(F.lit(url))) is ok
    assert one(spark, text.duration(F.lit(7500))) == "2 h 5 min" and one(spark, text.decoded(F.lit("&amp;lt; &quot;"))) == '&lt; "'
    assert spark.range(1).select(F.lit("  Ñandú ").alias("s")).select(text.folded("s").alias("x")).first()["x"] == "nandu"


def test_dates(spark):
    assert str(one(spark, dates.short_date(F.lit("2/29/24")))) == "2024-02-29" and one(spark, dates.short_date(F.lit("2/30/2024"))) is None
    assert one(spark, dates.month_day(F.lit(1332), F.lit(1999))) is None
    assert str(one(spark, dates.acquired(F.lit("2024-01-02"), F.lit(7)))) == "2024-01-02 00:07:00"
    assert one(spark, dates.iso_duration(F.lit("-PT1H30M"))) == -5400 and one(spark, dates.iso_duration(F.lit("1h"))) is None
    assert one(spark, dates.clock_seconds(F.lit("1:02:03"))) == 3723 and one(spark, dates.block_label(F.lit(2018))) == "2015-2019"


def test_index_breaks_and_runs(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 9)], "v double")
    assert {r.p: r["break"] for r in aggregates.index_breaks(v, "v", [0.0, 0.5, 0.8], 1).collect()} == {0.0: 1, 0.5: 2, 0.8: 9}
    c = spark.createDataFrame([(0, x, b) for x, b in ((0, 1), (1, 1), (2, 2), (4, 1))], "row int, x int, band int")
    assert sorted((r.band, r.first, r.last) for r in aggregates.runs(c, ["row"], "x", "band").collect()) == [(1, 0, 1), (1, 4, 4), (2, 2, 2)]


def test_resample_identity(spark):
    g = spark.range(12).select((F.col("id") % 4).cast("int").alias("ix"), F.floor(F.col("id") / 4).cast("int").alias("iy"), F.col("id").cast("double").alias("v"))
    out = {(r.x, r.y): r.v for r in grids.resample(g, 4, 3, 4, 3).collect()}
    assert all(out[i % 4, i // 4] == i for i in range(12)) and grids.same_geometry(g, g)


def test_commands(spark):
    df = spark.createDataFrame([(float(i), i % 3, 2.0 * i, "a" if i % 2 else None) for i in range(12)], "income double, grp int, pop double, tag string")
    r = commands.run(df, "summarize income and pop\ntabulate grp\nnonsense\nregress pop on income\nkeep if income is at least 1,0\nmean of pop by grp\nkeep valid data only\ncorrelate income with pop\nsummarize missing", {"grp": "Group"})
    assert [ok for _, ok, _ in r.steps] == [True, True, False, True, True, True, True, True, False]
    assert r.data.count() == 1 and r.tables[0].count() == 2 and r.tables[1].count() == 3
    assert commands.run(df, "drop if income is over 5 and pop under 100").data.count() == 6
    assert commands.run(df, "tabulate group", {"grp": "Group"}).steps[0][1]
    assert not commands.run(df, "keep if __import__('os') is 1").steps[0][1]


def test_xlsx_round_trip(spark, tmp_path):
    data = sinks.workbook({"One": pd.DataFrame({"geoid": ["01001", "01003"], "v": [1.5, None], "x": [True, False]}), "Two": pd.DataFrame({"a": ["ü<&"]})})
    (tmp_path / "a.xlsx").write_bytes(data)
    got = tabular.read_xlsx(spark, str(tmp_path / "a.xlsx")).orderBy("geoid").collect()
    assert [tuple(r) for r in got] == [("01001", "1.5", "True"), ("01003", None, "False")]
    assert tabular.xlsx_rows(data, "Two") == [["a"], ["ü<&"]]
    assert tabular.unique_headers(["a", None, "a"]) == ["a", "column_2", "a_2"]


def test_shapefile_round_trip(spark, tmp_path):
    outer, hole = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
    tabular.write_shapefile([("25025", [[outer, hole]]), ("44007", [[[(20, 0), (20, 1), (21, 1), (20, 0)]]])], str(tmp_path / "s"))
    got = {r.record: r.polygons for r in tabular.read_shapefile(spark, str(tmp_path / "s")).collect()}
    assert len(got) == 2 and len(got[0]) == 1 and len(got[0][0]) == 2
    assert [r.GEOID for r in tabular.read_dbf(spark, str(tmp_path / "s.dbf")).collect()] == ["25025", "44007"]


def test_stata_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("25025010405", 12.5, 3), ("99999999999", 7.0, 1)], "geoid string, `my value` double, `if` int")
    data, renamed = sinks.stata(df, {"if": {1: "No match", 3: "Matched"}})
    assert renamed == {"my value": "my_value", "if": "v_if"}
    (tmp_path / "a.dta").write_bytes(data)
    got = tabular.read_stata(spark, str(tmp_path / "a.dta"), "geoid string, my_value double, v_if int").collect()
    assert [tuple(r) for r in got] == [("25025010405", 12.5, 3), ("99999999999", 7.0, 1)]


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "A")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("in.zip")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))
    for name, data in (("x.tar.gz", gzip.compress(tar.getvalue())), ("b.txt.bz2", bz2.compress(b"B")), ("c.txt.xz", lzma.compress(b"C")), ("d.txt.zst", zstandard.compress(b"D"))):
        (tmp_path / name).write_bytes(data)
    got = sorted((r.name, bytes(r.content)) for r in feeds.read_archives(spark, str(tmp_path)).collect())
    assert got == [("a.txt", b"A"), ("b.txt", b"B"), ("c.txt", b"C"), ("d.txt", b"D")]
    assert feeds.kind_of("A.KMZ") == "kml" and feeds.kind_of("x.bin") is None


def rows(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_quakes(spark):
    f = lambda i, m: {"id": i, "properties": {"mag": m, "place": "p", "time": 1}, "geometry": {"coordinates": [1, 2, 3]}}
    got = feeds.earthquakes(rows(spark, {"features": [f("a", 3.0), f("b", 2.0)]}, {"features": [f("c", 4.0), f("c", 4.0)]}, {"features": [f("d", 4.0), f("e", None)]}))
    assert [r.id for r in got.collect()] == ["a"]


def test_aircraft(spark):
    v = ["abc123", "CALL  ", "US", 100, 101, -70.5, 42.5, 1000.0, False, 200.0, 90.0, 1.5, None, 1100.0]
    r = feeds.state_vectors(rows(spark, {"time": 1, "states": [v, [None] * 14]})).collect()
    assert len(r) == 1 and (r[0].id, r[0].callsign, r[0].position_ms, r[0].lat) == ("abc123", "CALL", 100000, 42.5)
    a = feeds.readsb(rows(spark, {"now": 10.0, "aircraft": [{"hex": "AB ", "lat": 1, "lon": 2, "alt_baro": "ground", "gs": 10, "seen_pos": 2.0}, {"hex": "x"}]})).collect()
    assert len(a) == 1 and a[0].on_ground and a[0].altitude_m is None and a[0].position_ms == 8000 and a[0].speed_mps == pytest.approx(5.14444)


def test_other_feeds(spark):
    v = feeds.vessels(spark.createDataFrame([("1", "1", "2", " A ", "70", "102.3", "360", "511"), ("2", "x", "2", "", "", "", "", ""), ("3", "1", "2", "", "", "", "bad", "10")], "mmsi string, lat string, lon string, name string, type string, speed string, course string, heading string")).orderBy("mmsi").collect()
    assert [(r.mmsi, r.speed, r.course, r.heading) for r in v] == [("1", None, None, None), ("3", None, None, 10.0)]
    info = rows(spark, {"data": {"stations": [{"station_id": "s", "name": "N", "lat": 1, "lon": 2, "capacity": 5}]}}, {"stations": [{"station_id": "u", "lat": 1, "lon": 2}]})
    status = rows(spark, {"data": {"stations": [{"station_id": "s", "num_bikes_available": 3, "num_docks_available": 2}]}})
    assert sorted((r.station_id, r.num_bikes_available) for r in feeds.stations(info, status).collect()) == [("s", 3), ("u", None)]
    lines = ["ISS", "1 25544U 98067A", "2 25544  51.6", "BAD", "1 00001U", "2 00002", "NEW", "1 B0001U", "2 B0001 "]
    got = feeds.element_sets(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string")).collect()
    assert sorted((r.name, r.catalog) for r in got) == [("ISS", 25544), ("NEW", 110001)]
    idx = spark.createDataFrame([("f", "1:0:d=1:UGRD:10 m:anl"), ("f", "2:500:d=1:VGRD:10 m:anl")], "file string, line string")
    assert [(r.first, r.last) for r in feeds.byte_inventory(idx, F.lit(900)).orderBy("first").collect()] == [(0, 499), (500, 899)]
    kml = "<kml><Placemark><styleUrl>#Smoke_Heavy</styleUrl><coordinates>0,0 1,0 1,1 0,0</coordinates></Placemark><Placemark><styleUrl>#x</styleUrl></Placemark></kml>"
    assert [(r.density, len(r.ring)) for r in feeds.smoke(rows(spark, kml)).collect()] == [(27, 4)]
    rss = "".join(f"<item><title><![CDATA[T{i % 3} &amp; x]]></title><link>https://www.n.org/{i}</link></item>" for i in range(7))
    assert [r.title for r in feeds.articles(rows(spark, rss)).collect()] == ["T0 & x", "T1 & x", "T2 & x"]
    pack = {"features": [{"id": "a", "geometry": {"coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    assert feeds.closed_pack(rows(spark, pack)).count() == 1
    pack["features"].append(pack["features"][0])
    with pytest.raises(ValueError):
        feeds.closed_pack(rows(spark, pack))
    assert feeds.first_readable(spark, ["/nowhere/a", "/nowhere/b"]) is None
    pages = feeds.offset_pages(spark, lambda offset, size: [{"id": i // 2} for i in range(offset, offset + size)], 3, 4, "id long", "id")
    assert sorted(r.id for r in pages.collect()) == [0, 1, 2, 3, 4, 5]


def test_sinks(spark, tmp_path, areas):
    sinks.write_layer(areas.withColumn("chunk", F.substring("geoid", 1, 5)), str(tmp_path / "layer"))
    assert spark.read.json(str(tmp_path / "layer/features")).count() == 3
    p = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "s string, v int"), p, "s")
    sinks.replace_partitions(spark.createDataFrame([("b", 3)], "s string, v int"), p, "s")
    assert sorted((r.s, r.v) for r in spark.read.parquet(p).collect()) == [("a", 1), ("b", 3)]
    key = b"0123456789abcdef"
    assert one(spark, sinks.decrypted(sinks.encrypted(F.lit("secret ü"), key), key)) == "secret ü"
    assert len(one(spark, sinks.fingerprint(F.lit(1), F.lit(None), salt="s"))) == 12
    saved = sinks.Saved(spark, "saved_test")
    saved.save("one", areas)
    assert saved.list() == ["one"] and saved.get("one").count() == 3
    saved.delete("one")
    assert saved.list() == []


def test_reconcile(spark):
    state = spark.createDataFrame([("111", 1.0, 0, 0, "add"), ("222", 2.0, 0, 0, "add")], "mmsi string, speed double, seen_ms long, missed int, change string")
    poll = spark.createDataFrame([("111", None), ("333", 3.0)], "mmsi string, speed double")
    got = {r.mmsi: (r.speed, r.change) for r in live.reconciled(state, poll, "mmsi", ["speed"], True, 60_000).collect()}
    assert got == {"111": (1.0, "update"), "222": (2.0, "remove"), "333": (3.0, "add")}
    partial = {r.mmsi: r.change for r in live.reconciled(state, poll, "mmsi", ["speed"], False, 60_000).collect()}
    assert partial["222"] == "keep"
    late = {r.mmsi: r.change for r in live.reconciled(state, poll, "mmsi", ["speed"], False, 600_000).collect()}
    assert late["222"] == "remove"
    pinned = state
    for n in range(5):
        pinned = live.reconciled(pinned, spark.createDataFrame([("111", 1.0)], "mmsi string, speed double"), "mmsi", ["speed"], True, 60_000 * n, selected="222")
        assert {r.mmsi: r.change for r in pinned.collect()}.get("222") == ("keep" if n < 3 else "remove" if n == 3 else None)
    assert live.reconciled(state, poll.limit(0), "mmsi", ["speed"], True, 1).where("change = 'keep'").count() == 2


def test_history_ring():
    r = live.Ring()
    assert all(r.add(i * 1000, 0.0, 0.0, "a" if i < 100 else "b") for i in range(200)) and not r.add(199_000, 0, 0, "b")
    assert len(r.fixes) == 128 and r.truncated and len(r.epochs) == 2
    assert r.add(199_000 + live.TTL_MS + 1, 0, 0, "b") and len(r.fixes) == 1
    t = live.Track()
    assert [t.accept(i * 1000, 0.0, x) for i, x in ((0, 0.0), (1, 0.0001), (2, 1.0), (3, 0.0002), (4, 1.0), (5, 1.0001))] == ["path", "path", "wait", "path", "wait", "break"]


def test_history_stream_equals_batch(spark, tmp_path):
    rows_ = [(k, i * 60_000, 0.0, i * 0.001, "t") for k in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows_, "key long, ms long, lat double, lon double, trip string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.history_stream(stream).writeStream.format("memory").queryName("hist").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hist").collect())) == sorted(map(tuple, live.history_batch(df).collect()))


def test_linked_lines_and_identity(spark):
    a = spark.createDataFrame([("ABC123", "UAL12", 1), ("XYZ", "ABC", 2), ("q", "ABCDE", 3)], "hex string, callsign string, n int")
    assert joins.ranked_identity(a, "abc", ["hex", "callsign"], "n").first().n == 2
    x = spark.createDataFrame([("road", 464), ("road", 700)], "street string, num int")
    y = spark.createDataFrame([("road", 451, 521)], "street string, lo int, hi int")
    assert [r.num for r in joins.interval(x, y, ["street"], "num", "lo", "hi", 50).collect()] == [464]


def test_streams_write_to_the_shared_folder(spark):
    """Streams leave no rows on the driver: output and checkpoint lie below spark.checkpoint.dir."""
    from geoloom.plans import live as plans
    from tests.compare import SF

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    for query in (plans.stream_st5_no_repeats, plans.stream_st13_daily):
        files = query(spark, SF).inputFiles()
        assert files and all(f"{shared}/streams/" in f for f in files)
