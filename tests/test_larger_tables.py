"""What only larger or odder tables show: joins that must not be broadcast, calm air, readings that look like sentinels, ties."""

from __future__ import annotations

import json
import math
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoloom.functions import geo, shapes
from geoloom.operators import joins, routes, scratch
from geoloom.plans import joining, sourced, written
from geoloom.sources import feeds, paged, places


def test_flows_meet_roads_without_the_driver(spark):
    """A line's cells near the pole are narrower than the reach; and no side goes through the driver by its size on disk."""
    line = lambda lon: [(lon, 80.0 + 0.001 * i) for i in range(3)]
    coords = "array<struct<lon:double,lat:double>>"
    roads = spark.createDataFrame([(1, False, line(0.0009)), (2, False, line(0.5))], f"road long, oneway boolean, coords {coords}")
    flows = spark.createDataFrame([(1, 0.25, False, line(0.0009 + 0.00155)), (2, 0.5, False, line(0.5 + 0.0022))], f"flow long, level double, closure boolean, coords {coords}")
    got = routes.matched_flows(roads, flows)
    assert [tuple(r) for r in got.collect()] == [(1, 0.25, False)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_calm_air(spark):
    """atan2 of zeros with signs, as IEEE and DuckDB have it."""
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, -0.0), (3, 0.0, 5.0), (4, 1.0, 0.0), (5, None, 0.0)], "n int, u double, v double")
    _, way = geo.wind("u", "v")
    assert [r[0] for r in rows.orderBy("n").select(way).collect()] == [180.0, 0.0, 180.0, 270.0, None]


def test_fuzzy_ties_go_to_the_smallest(spark):
    a = spark.createDataFrame([(1, 100.0)], "id int, size double")
    b = spark.createDataFrame([(9, 90.0), (4, 110.0), (7, 110.0), (3, 110.00000001)], "other int, other_size double")
    town = F.array(F.lit("town"))
    got = lambda **k: joins.fuzzy(a.withColumn("n", F.lit(0)), b.withColumn("n", F.lit(0)), town, town, ["n"], "size", "other_size", ["id"], **k).select("other", "away").first()
    assert tuple(got(digits=9, first=["other"])) == (3, 0.1)
    assert got(first=["other"])["other"] == 4


def test_a_reading_that_equals_a_sentinel(spark, tmp_path):
    texts = [("1", "1", "2", "a", "70", "+102.3", "+360", ""), ("2", "1", "2", "a", "70", "102.3", "360.0", "511"), ("3", "1", "2", "a", "70", "-1.5", "", "")]
    df = spark.createDataFrame(texts, "mmsi string, lat string, lon string, name string, type string, speed string, course string, heading string")
    got = feeds.vessels(df, signed=True).orderBy("mmsi").select("speed", "course").collect()
    assert [tuple(r) for r in got] == [(102.3, 360.0), (None, None), (-1.5, None)]
    assert feeds.vessels(df).where("mmsi = '1'").first()["speed"] is None
    spark.sql("SELECT event_id, timestamp '2024-01-01' AS ts, 7L AS user_id, 'x' AS event_type, value, concat('{\"k\": ', k, '}') AS props FROM VALUES (1L, 102.3D, 14), (2L, 102.3D, 3), (3L, 1.0E-5D, 1) AS t(event_id, value, k)").write.parquet(f"{tmp_path}/events.parquet")
    speeds = sourced.scan_s20_vessel_sentinels(spark, str(tmp_path)).collect()
    assert sorted((r["knots"] is None, r["knots"]) for r in speeds if r["knots"] is not None) == [(False, 1e-5), (False, 102.3)]
    assert len(speeds) == 3


def test_catalog_numbers_of_more_than_five_columns(spark, tmp_path):
    lines = ["A", "1 1234567U 24001A", "2 1234567  51.6", "B", "1 1234567U 24001A", "2 1234568  51.6", "C", "1 Z9999U 24001A", "2 Z9999  51.6", "D", "1 12345U 24001A", "2 123456  51.6"]
    got = feeds.element_sets(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string")).select("name", "catalog")
    assert sorted(map(tuple, got.collect())) == [("A", 1234567), ("C", 339999)]
    keys = [99_999, 100_001, 100_004, 239_995, 240_000, 339_999, 340_001, 1_200_001, 6_999_999]
    spark.createDataFrame([(k, f"part {k}") for k in keys], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sourced.scan_s22_element_triples(spark, str(tmp_path)).collect()
    assert sorted(r["catalog"] for r in got) == sorted(100_000 + k if k % 5 == 0 else k for k in keys if k % 7)


def test_pairs_that_lines_ask_for(spark, tmp_path):
    """A part listed twice is one part, and pairs that no line has are not made."""
    spark.sql("SELECT * FROM VALUES (1L), (1L), (101L), (2L) AS t(p_partkey)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT * FROM VALUES (1L), (201L), (3L) AS t(s_suppkey)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 1L, 2.5D), (1L, 1L, 1.5D), (1L, 3L, 9D), (101L, 201L, 4D), (301L, 1L, 7D), (2L, 2L, 7D) AS t(l_partkey, l_suppkey, l_quantity)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = joining.join_j12_composite_key(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 4.0), (101, 201, 1, 4.0)]


def test_lists_of_what_is_near(spark):
    """Lists are made without a shuffle of pairs: across the date line and over a pole, ties by the smaller key, none left out."""
    a = spark.createDataFrame([("line", 0.0, 179.9), ("pole", 89.9, 10.0), ("none", -50.0, 0.0)], "geoid string, lat double, lon double")
    b = spark.createDataFrame([(5, 0.0, -179.9), (4, 0.0, 179.0), (2, 0.1, 179.9), (1, -0.1, 179.9), (7, 89.9, -170.0), (8, 88.0, 10.0)], "site long, blat double, blon double")
    got = joins.listed_within(a, b, "geoid", "site", 300.0)
    assert {r["geoid"]: r["others"] for r in got.collect()} == {"line": [1, 2, 5, 4], "pole": [7, 8]}
    many = a.where("geoid = 'line'").crossJoin(spark.range(3 * joins.LIST_ROWS)).select("id", "lat", "lon")
    assert joins.listed_within(many, b, "id", "site", 300.0).where("others = array(1L, 2L, 5L, 4L)").count() == 3 * joins.LIST_ROWS


def test_pairs_within_a_distance_are_spread(spark):
    """A table of one file is dealt out before it meets more rows than it has."""
    a = spark.range(4000).coalesce(1).select("id", F.lit(10.0).alias("lat"), (F.col("id") % 360 - 180.0).alias("lon"))
    b = spark.range(3).select(F.col("id").alias("site"), F.lit(10.0).alias("blat"), F.col("id").cast("double").alias("blon"))
    got = joins.within(a, b, 150.0)
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert got.count() == sum(abs(i % 360 - 180 - s) <= 1 for i in range(4000) for s in range(3))


def test_short_and_long_lines_are_simplified_alike(spark, tmp_path):
    bend = [(float(i), float(i % 7 * (i % 11))) for i in range(shapes.FEW + 30)]
    for some in (bend[: shapes.FEW], [*bend[: shapes.FEW - 1], bend[0]]):
        for infinite in (False, True):
            doubled = [p for a, b in zip(some, some[1:]) for p in (a, ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2))] + [some[-1]]
            assert shapes.simplified(some, 3.0, infinite) == [p for p in shapes.simplified(doubled, 3.0, infinite)]
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (2.0, 2.0)]), (2, None), (3, [])], "n int, r array<struct<x:double,y:double>>")
    got = rings.orderBy("n").select(shapes.simplify_udf(F.col("r"), 0.1)).collect()
    assert [[tuple(p) for p in r[0]] for r in got] == [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)], [], []]
    spark.range(2000).selectExpr("id AS c_custkey", "id % 3 AS c_nationkey", "'n' AS c_name", "1.0D AS c_acctbal", "'m' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3).selectExpr("id AS n_nationkey", "'n' AS n_name", "0L AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    for q in (written.array_a4_hull, written.array_a5_simplified, written.array_a6_cleaned):
        assert q(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1


def test_files_are_handed_on_in_turn():
    """Of a batch of many large rows few are held at once, and rows go on before the batch is done."""
    made = []

    def make(r):
        made.append(r["n"])
        yield r["n"], b"x" * (feeds.TOGETHER_BYTES // 4)

    out = feeds.in_turn(make, [("n", pa.int64()), ("content", pa.binary())])(iter([pa.RecordBatch.from_pydict({"n": list(range(100))})]))
    assert next(out).num_rows <= 4 and len(made) <= 4
    assert sum(b.num_rows for b in out) + 4 >= 100 and made == list(range(100))


def test_regions_go_down_to_what_is_nearest(spark, monkeypatch):
    """Rows are not copied to the cells they may be nearest to; regions are split, and dealt out in parts, with the same results."""
    written, sizes = scratch.written, []
    monkeypatch.setattr(scratch, "written", lambda df: (out := written(df), sizes.append(out.count()))[0])
    rng = np.random.default_rng(9)
    even = lambda n, lat, lon, width: np.stack([np.clip(lat + width * (rng.random(n) - 0.5), -90, 90), (lon + width * (rng.random(n) - 0.5) + 180) % 360 - 180], axis=1)
    rows = np.vstack([even(3000, 20, 10, 60), even(600, 0, 180, 1), even(300, 89.9, 0, 0.4), [[0, 180.0], [0, -180.0], [90, 5], [-90, -7], [0, 0.5]]])
    places = np.vstack([even(1500, 20, 10, 60), even(300, 0, 180, 0.2), even(100, 89.9, 0, 0.4), [[0, 0.0], [0, 1.0]]])
    a = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "id long, lat double, lon double")
    b = spark.createDataFrame([(f"s{i:05}", *map(float, p)) for i, p in enumerate(places)], "site string, lat double, lon double")
    p, q = np.radians(rows), np.radians(places)
    h = np.sin((p[:, None, 0] - q[:, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(q[:, 0]) * np.sin((p[:, None, 1] - q[:, 1]) / 2) ** 2
    least = (2 * geo.KM * np.arcsin(np.sqrt(np.minimum(1, h)))).min(axis=1)
    few = dict(NEAR_PLACES=40, NEAR_ROWS=16, NEAR_PRODUCTS=1000)
    for k, limits in enumerate(({}, few)):
        for name, value in limits.items():
            monkeypatch.setattr(joins, name, value)
        got = {r["id"]: (r["site"], r["km"]) for r in joins.nearest(a, b, "id", "site", radius=geo.KM).collect()}
        assert len(got) == len(rows) and np.allclose([got[i][1] for i in range(len(rows))], least, rtol=1e-9, atol=1e-4)
        assert got[len(rows) - 1][0] == f"s{len(places) - 2:05}"  # of two as near the smaller
        assert k or max(sizes) <= max(len(rows), 9 * len(places))
        if not k:
            sizes.clear()
            joins.nearest(a, b.where("site < 's00020'"), "id", "site").count()
            assert max(sizes) <= len(rows)


def test_pages_are_read_by_no_more_tasks_than_shuffles_have(spark, tmp_path, monkeypatch):
    """More pages make no more tasks, and every page is read, the last short one too."""
    objects, asked = paged.objects, []
    monkeypatch.setattr(paged, "objects", lambda *a, **options: (asked.append(options), objects(*a, **options))[1])
    spark.range(20_300).selectExpr("id * 3 AS o_orderkey", "id / 4.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    got = written.scan_s32_paged_reader(spark, str(tmp_path))
    assert got.count() == 20_300 and got.where("v = objectid / 12.0D").count() == 20_300
    options = {k: str(v) for k, v in asked[0].items()}
    spans = paged._spans(0, asked[0]["count"], options)
    assert 1 < len(spans) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [x.first for x in spans[1:]] == [x.end for x in spans[:-1]] and (spans[0].first, spans[-1].end) == (0, 20_300)


def test_granules_are_sorted_once(spark):
    """A task holds one sort of what is kept of the answers; pages after the last, rows past the most and those without a start go."""
    start = {"TemporalExtent": {"RangeDateTime": {"BeginningDateTime": "2024-01-02T00:00:00Z"}}}
    box = {"SpatialExtent": {"HorizontalSpatialDomain": {"Geometry": {"GPolygons": [{"Boundary": {"Points": [{"Longitude": 1, "Latitude": 1}]}}], "BoundingRectangles": [{f"{x}BoundingCoordinate": k for k, x in enumerate(("West", "South", "East", "North"))}]}}}}
    answer = lambda hits, *ids: json.dumps({"hits": hits, "items": [{"meta": {"concept-id": i}, "umm": ({} if i == "late" else start) | (box if i == "b" else {})} for i in ids]})
    rows = [(1, 0, "c", answer(5, "a", "late", "b")), (1, 1, "c", None), (1, 2, None, answer(5, "c", "d")), (1, 3, "c", answer(5, "e")), (2, 0, None, answer(1, "f")), (3, 0, None, answer(9)), (None, 0, None, answer(1, "g"))]
    pages = spark.createDataFrame(rows, "search long, page int, cursor string, value string").repartition(3)
    got = lambda most: sorted((r["search"], r["id"], r["truncated"]) for r in places.granules(pages, most).collect())
    assert got(None) == got(4) == [(1, "a", True), (1, "b", True), (1, "c", True), (1, "d", True), (2, "f", False)]
    assert got(3) == [(1, "a", True), (1, "b", True), (1, "c", True), (2, "f", False)]
    assert got(1) == [(1, "a", True), (2, "f", False)]
    found = places.granules(pages)
    assert {r["id"]: r["ring"] and [tuple(p) for p in r["ring"]] for r in found.collect()}["b"] == [(0, 1), (2, 1), (2, 3), (0, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Sort [") == 1 and "Join" not in plan


def test_crowded_cells_are_met_in_parts(spark, tmp_path, monkeypatch):
    """Pairs of a crowded cell go to many tasks with the same result, and equal distances of a task lie together."""
    a = spark.range(3000).select("id", (F.col("id") % 7 / 10).alias("lat"), (F.col("id") / 3000).alias("lon"))
    b = spark.range(40).select(F.col("id").alias("site"), F.lit(0.3).alias("blat"), (F.col("id") / 20 - 0.5).alias("blon"))
    met = lambda: {(r["id"], r["site"]): r["km"] for r in joins.within(a, b, 60.0).collect()}
    p, q = np.radians([[i % 7 / 10, i / 3000] for i in range(3000)]), np.radians([[0.3, i / 20 - 0.5] for i in range(40)])
    h = np.sin((p[:, None, 0] - q[:, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(q[:, 0]) * np.sin((p[:, None, 1] - q[:, 1]) / 2) ** 2
    away = 2 * geo.KM * np.arcsin(np.sqrt(h))
    whole = met()
    assert set(whole) == {(int(i), int(j)) for i, j in np.argwhere(away <= 60.0)} and all(abs(v - away[k]) < 1e-9 for k, v in whole.items())
    monkeypatch.setattr(joins, "PART_PAIRS", 2000)
    monkeypatch.setattr(joins, "TASK_PAIRS", 4000)
    assert met() == whole
    got = joins.within(a, b, 60.0)
    assert got.rdd.getNumPartitions() >= 15 and got.select(F.spark_partition_id()).distinct().count() > 8
    spark.sql("SELECT id AS event_id, timestamp '2024-01-01' AS ts, 7L AS user_id, 'x' AS event_type, 1.0D AS value, '{}' AS props FROM range(500)").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT id AS s_suppkey, 1.0D AS s_acctbal FROM range(50)").write.parquet(f"{tmp_path}/supplier.parquet")
    parts = [[r["km"] for r in p] for p in joining.join_j15_radius(spark, str(tmp_path)).rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts) and sum(map(len, parts)) > 100


def test_halves_are_rounded_up(spark):
    rows = spark.createDataFrame([(0.0005,), (0.0004999,), (249.9995,), (1.0005,), (0.0,), (20015.086,), (None,)], "v double")
    assert [r[0] for r in rows.select(geo.half_up("v", 3)).collect()] == [0.001, 0.0, 250.0, 1.001, 0.0, 20015.086, None]


def test_lists_do_not_take_a_side_through_the_driver(spark, tmp_path, monkeypatch):
    """Files of few bytes hold many places, and each is copied to many cells: neither side is broadcast, however small its file."""
    spark.range(300).selectExpr("concat('g', id) AS geoid", "id % 9 / 10.0D AS lat", "id / 300.0D AS lon").write.parquet(f"{tmp_path}/a")
    spark.range(60).selectExpr("id AS site", "0.4D AS blat", "id / 40.0D AS blon").write.parquet(f"{tmp_path}/b")
    a, b = (spark.read.parquet(f"{tmp_path}/{x}") for x in "ab")
    lists = lambda: joins.listed_within(a, b, "geoid", "site", 70.0)
    whole = {r["geoid"]: r["others"] for r in lists().collect()}
    assert len(whole) == 300 and max(map(len, whole.values())) < 60
    monkeypatch.setattr(joins, "LIST_PAIRS", 600)
    got = lists()
    assert {r["geoid"]: r["others"] for r in got.collect()} == whole
    sent = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].split("BroadcastExchange")[1:]
    assert sent and all(re.search(r"FileScan parquet \[(\w+)#", x)[1] == "_cell" for x in sent)


def test_fuzzy_holds_no_row_against_its_whole_group(spark):
    """Neighbours in order of size, spans of equally close ones, sizes below zero, nulls and several names: as all pairs give it."""
    rng = np.random.default_rng(4)
    sizes = lambda n: [None if k % 41 == 0 else float(v) for k, v in enumerate(np.round(rng.normal(40, 60, n), 0))]
    a = [(i, None if i % 29 == 0 else i % 3, v) for i, v in enumerate(sizes(200))] + [(200, 0, 0.0), (201, 1, math.nan), (202, 2, 1e9), (203, 9, 5.0)]
    b = [(1000 - j, None if j % 31 == 0 else j % 3, v, ["p", "q"][: 1 + j % 2]) for j, v in enumerate(sizes(300))] + [(5, 0, math.nan, ["p"]), (6, 1, 12.0, None), (7, 2, math.inf, ["q"])]
    left = spark.createDataFrame(a, "id int, g int, size double")
    right = spark.createDataFrame(b, "other int, g int, other_size double, names array<string>")
    for digits, most in ((9, 0.5), (1, 0.5), (2, 3.0)):
        want = {}
        for i, g, v in a:
            tried = [(abs(v - w) / v, o) for o, h, w, names in b if None not in (g, h, v, w, names) and g == h and v and names]
            tried = [(float(Decimal(repr(d)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if math.isfinite(d) else d, o) for d, o in tried if d < most]
            if tried:
                want[i] = min(tried)
        got = joins.fuzzy(left, right, F.array(F.lit("p"), F.lit("q")), F.col("names"), ["g"], "size", "other_size", ["id"], most, digits, ["other"])
        assert got.columns == ["g", "id", "size", "other", "other_size", "names", "away"]
        found = {r["id"]: (r["away"], r["other"]) for r in got.collect()}
        assert found.keys() == want.keys() and all(math.isclose(found[k][0], want[k][0], abs_tol=2e-9) and found[k][1] == want[k][1] for k in want)
    made = spark.range(20_000).select(F.col("id").alias("other"), F.lit(1).alias("g"), (F.col("id") * 7919 % 20_011 + 1.0).alias("other_size"), F.array(F.lit("p")).alias("names"))
    some = spark.range(20_000).select("id", F.lit(1).alias("g"), (F.col("id") * 31 % 20_011 + 1.25).alias("size"))
    got = joins.fuzzy(some, made, F.array(F.lit("p")), F.col("names"), ["g"], "size", "other_size", ["id"], 0.5, 9, ["other"])
    assert got.where("abs(size - other_size) > 1.25").count() <= 20 and got.count() == 20_000
    met = re.findall(r"Join Inner, .*", got._jdf.queryExecution().optimizedPlan().toString())
    assert met and all("_n#" in m for m in met)
