"""Registered round trips of the writers and of file formats, plans, and shapes: written to where executors share, and read back."""

from __future__ import annotations

import io
import uuid

import pandas as pd
from pyspark.sql import functions as F

from geoloom.functions import dates, geo, records, shapes, text
from geoloom.operators import aggregates, grids, joins, layers, routes, scratch, stats
from geoloom.plans import commands, merge, report
from geoloom.plans.base import FEED, TRACTS, feed, shared, t, tracts
from geoloom.plans.registry import register
from geoloom.sources import feeds, lookups, paged, places, sinks, tabular
from geoloom.streaming import live

#: Rows of a file that a group of rows becomes.
FILE_ROWS = 500


def _folder(spark) -> str:
    return f"{shared(spark)}/written/{uuid.uuid4().hex}"


@register(f"WITH {TRACTS} SELECT county AS chunk, count(*) AS areas, sum(pop)::BIGINT AS pop, count(*) AS listed FROM tracts GROUP BY county")
def sink_k1_layer(spark, d):
    """A chunked layer and its index, read back together."""
    path = _folder(spark)
    sinks.write_layer(tracts(spark, d).select(F.concat(F.lit("c"), "county").alias("chunk"), "geoid", "pop", "lon", "lat"), path)
    rows = spark.read.schema("geoid string, pop long, lon double, lat double, chunk string").json(f"{path}/features").groupBy("chunk").agg(F.count(F.lit(1)).alias("areas"), F.sum("pop").alias("pop"))
    index = spark.read.schema("chunk string, areas long").json(f"{path}/index").select("chunk", F.col("areas").alias("listed"))
    return rows.join(index, "chunk").select(F.substring("chunk", F.lit(2), F.length("chunk")).alias("chunk"), "areas", "pop", "listed")


@register("SELECT p_partkey, p_name || ', \"x\"' AS p_name, p_size FROM part")
def sink_k2_csv(spark, d):
    path = _folder(spark)
    sinks.write_csv(t(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(', "x"')).alias("p_name"), "p_size"), path)
    lines = spark.read.text(path).where(~F.col("value").startswith("p_partkey,"))  # Spark drops the byte order mark
    return tabular.csv_rows(lines, "p_partkey long, p_name string, p_size int")


def _workbooks(key, rows: pd.DataFrame) -> pd.DataFrame:
    data = rows[["s_suppkey", "s_name", "s_acctbal"]].sort_values("s_suppkey")
    return pd.DataFrame({"content": [sinks.workbook({"suppliers": data})]})


def _grouped(df, key: str):
    return df.withColumn("file", F.floor(F.col(key) / FILE_ROWS)).groupBy("file")


@register("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, s_acctbal FROM supplier")
def scan_s11_workbooks(spark, d):
    """Workbooks of some hundred rows each, made and read on the executors (also K4)."""
    files = _grouped(t(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")), "s_suppkey").applyInPandas(lambda k, x: _workbooks(k, x), "content binary")
    rows = tabular.parsed_files(files, tabular.xlsx_table, "s_suppkey string, s_name string, s_acctbal string")
    return rows.select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


def _square(x: float, y: float) -> list:
    outer = [(x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y), (x, y)]
    hole = [(x + 0.25, y + 0.25), (x + 0.75, y + 0.25), (x + 0.75, y + 0.75), (x + 0.25, y + 0.25)]
    return [[outer, hole]]


@register(f"WITH {TRACTS} SELECT geoid, 1 AS polygons, 2 AS rings, round(1 - 0.125, 6) AS area FROM tracts")
def scan_s12_shapefiles(spark, d):
    """Shapefiles of some hundred areas with holes, written and read on the executors (also K5)."""

    def made(key, rows: pd.DataFrame) -> pd.DataFrame:
        parts = tabular.shapefile([(g, _square(x, y)) for g, x, y in zip(rows["geoid"], rows["lon"], rows["lat"])])
        return pd.DataFrame({"content": [parts["shp"]], "dbf": [parts["dbf"]]})

    def read(batches):
        for b in batches:
            for shp, dbf in zip(b["content"], b["dbf"]):
                polygons = [tabular.polygons(s) for s in tabular.shp_shapes(bytes(shp))]
                area = [sum(abs(tabular.signed_area(r)) * (1 if k == 0 else -1) for p in ps for k, r in enumerate(p)) for ps in polygons]
                yield pd.DataFrame({"geoid": tabular.dbf_table(bytes(dbf))["GEOID"], "polygons": [len(p) for p in polygons], "rings": [sum(map(len, p)) for p in polygons], "area": [round(a, 6) for a in area]})

    files = _grouped(tracts(spark, d).select("geoid", F.col("lon").cast("double").alias("lon"), "lat", "k"), "k").applyInPandas(lambda k, x: made(k, x), "content binary, dbf binary")
    return files.mapInPandas(read, "geoid string, polygons int, rings int, area double")


@register("SELECT c_custkey AS id, c_name AS v_if, c_acctbal AS balance FROM customer")
def scan_s13_stata(spark, d):
    """Stata files of some hundred rows, names made legal, written and read on the executors (also K3)."""

    def made(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"content": [sinks.stata_bytes(rows[["id", "if", "balance"]])[0]]})

    source = t(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("if"), F.col("c_acctbal").cast("double").alias("balance"))
    files = _grouped(source, "id").applyInPandas(lambda k, x: made(k, x), "content binary")
    return tabular.parsed_files(files, lambda data: pd.read_stata(io.BytesIO(data)), "id int, v_if string, balance double")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS nation, CAST(count(*) AS VARCHAR) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'US', CAST(count(*) AS VARCHAR) FROM supplier")
def sink_k6_tsv(spark, d):
    path = _folder(spark)
    s = t(spark, d, "supplier")
    counts = s.groupBy(F.col("s_nationkey").cast("string").alias("nation")).agg(F.count(F.lit(1)).cast("string").alias("suppliers"))
    sinks.write_tsv(counts, path, s.agg(F.lit("US").alias("nation"), F.count(F.lit(1)).cast("string").alias("suppliers")))
    return spark.read.option("sep", "\t").option("header", True).csv(path)


@register("SELECT o_orderkey, substr(sha256('salt|' || o_orderkey || '|' || coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, '')), 1, 12) AS print FROM orders")
def sink_k7_fingerprint(spark, d):
    return t(spark, d, "orders").select("o_orderkey", sinks.fingerprint(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")), salt="salt").alias("print"))


@register(f"WITH {TRACTS}, k AS (SELECT * FROM tracts WHERE pop >= 100) SELECT 'data' AS part, CAST(count(*) AS BIGINT) AS lines FROM k UNION ALL SELECT 'map', count(*) FROM (SELECT DISTINCT county FROM k) UNION ALL SELECT 'script', 2 UNION ALL SELECT 'log', 2")
def sink_k9_session(spark, d):
    """A session's folder: what a script leaves of the data, a map table, the script and its log."""
    path, script = _folder(spark), "keep if pop is at least 100\nabracadabra"
    r = commands.run(tracts(spark, d).select("geoid", "county", "pop"), script)
    log = [f"{'ok' if ok else 'error'}: {line} {why}".strip() for line, ok, why in r.steps]
    sinks.write_session(path, r.data, script.splitlines(), log, {"county": r.data.groupBy("county").agg(F.sum("pop").alias("pop"))})
    count = lambda p, name: spark.read.text(f"{path}/{p}").where(~F.col("value").rlike("^(geoid|county),")).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("lines"))
    return count("data.csv", "data").unionByName(count("map_county.csv", "map")).unionByName(count("script.txt", "script")).unionByName(count("log.txt", "log"))


@register(f"WITH {TRACTS} SELECT state, sum(CASE WHEN state IN ('01', '03') THEN pop + 1 ELSE pop END)::BIGINT AS pop FROM tracts GROUP BY state")
def sink_k10_replaced_states(spark, d):
    path = _folder(spark)
    x = tracts(spark, d).select("geoid", "pop", F.concat(F.lit("s"), "state").alias("state"))
    sinks.replace_partitions(x, path, "state")
    sinks.replace_partitions(x.where("state in ('s01', 's03')").withColumn("pop", F.col("pop") + 1), path, "state")
    back = spark.read.schema("geoid string, pop long, state string").parquet(path)
    return back.groupBy(F.substring("state", F.lit(2), F.length("state")).alias("state")).agg(F.sum("pop").alias("pop"))


@register("SELECT s_suppkey, s_name FROM supplier")
def sink_k11_saved(spark, d):
    saved, name = sinks.Saved(spark, "kept"), f"t{uuid.uuid4().hex}"
    saved.save(name, t(spark, d, "supplier").select("s_suppkey", "s_name"))
    assert name in saved.list()
    return saved.get(name)


@register("SELECT column_name AS old, CASE column_name WHEN 'c_custkey' THEN 'c_custkey' ELSE column_name END AS new, CASE WHEN column_name IN ('c_custkey', 'c_nationkey', 'c_acctbal') THEN 'numeric' ELSE 'string' END AS kind, (SELECT count(*) FROM customer) AS n FROM (DESCRIBE customer)")
def project_p1_p2_variables(spark, d):
    """Each column's legal name and kind, and how many rows have it."""
    c = t(spark, d, "customer")
    names, kinds = layers.legal_names(c.columns), layers.kinds(c)
    each = F.array(*(F.struct(F.lit(x).alias("old"), F.lit(names[x]).alias("new"), F.lit(kinds[x]).alias("kind")) for x in c.columns))
    return c.agg(F.count(F.lit(1)).alias("n")).select(F.inline(each), "n")


@register(f"WITH {TRACTS} SELECT geoid, pop AS population, income AS household_income FROM tracts")
def project_p4_measures(spark, d):
    return layers.rows(tracts(spark, d), {"pop": "population", "income": "household_income"}, ["geoid", "pop", "income"])


@register(f"WITH {FEED} SELECT seq, CASE WHEN lon - floor(lon / 20) * 20 < 10 AND lat - floor(lat / 20) * 20 < 10 THEN CAST(floor(lon / 20) AS BIGINT) * 1000 + CAST(floor(lat / 20) AS BIGINT) END AS area FROM feed WHERE lon - floor(lon / 20) * 20 < 10 AND lat - floor(lat / 20) * 20 < 10 AND NOT (lon - floor(lon / 20) * 20 BETWEEN 2 AND 4 AND lat - floor(lat / 20) * 20 BETWEEN 2 AND 4)")
def filter_f11_points_in_areas(spark, d):
    """Points within squares of a checkerboard, which have a hole each."""
    p = lambda x, y, dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    ring = lambda x, y, a, b: F.array(p(x, y, a, a), p(x, y, b, a), p(x, y, b, b), p(x, y, a, b), p(x, y, a, a))
    points = feed(spark, d).select("seq", F.col("lon").alias("x"), F.col("lat").alias("y"))
    cells = points.select(F.floor(F.col("x") / 20).alias("i"), F.floor(F.col("y") / 20).alias("j")).distinct()
    x, y = F.col("i") * 20, F.col("j") * 20
    area = (F.col("i") * 1000 + F.col("j")).alias("area")
    rings = cells.select(area, F.lit(0).alias("part"), F.lit(False).alias("hole"), ring(x, y, 0, 10).alias("ring")).unionByName(cells.select(area, F.lit(0).alias("part"), F.lit(True).alias("hole"), ring(x, y, 2, 4).alias("ring")))
    return joins.points_in_rings(points, rings, "area", 5.0).select("seq", "area")


@register(f"WITH {TRACTS} SELECT geoid, pop FROM tracts WHERE pop >= 100 AND income > 1000 AND segment <> 'BUILDING' AND minority <= 250")
def filter_f18_plain_conditions(spark, d):
    x = tracts(spark, d)
    c = commands.condition("pop is at least 100 and income over 1,000 and segment is not BUILDING and people of minority at most 250", x, {"minority": "people of minority"})
    return x.where(c).select("geoid", "pop")


@register(f"WITH {TRACTS} SELECT geoid, pop FROM tracts WHERE income IS NOT NULL AND NOT (pop > 500)")
def filter_f19_refused_lines(spark, d):
    """A script of which only the lines of the closed language count; the others are refused one by one."""
    x = tracts(spark, d).select("geoid", "pop", "income")
    r = commands.run(x, "keep valid data only\nsystem('ls')\n!rm file\ndrop if pop is over 500\nkeep if nothing is 3")
    assert [ok for _, ok, _ in r.steps] == [True, False, False, True, False]
    return r.data.select("geoid", "pop")


@register(f"WITH {TRACTS}, u AS (SELECT county AS geoid, count(*) AS visits FROM tracts GROUP BY county), s AS (SELECT county AS geoid, sum(pop)::BIGINT AS pop FROM tracts WHERE county NOT LIKE '%3' GROUP BY county) SELECT u.geoid, visits, pop, CASE WHEN s.geoid IS NULL THEN 1 ELSE 3 END AS _merge FROM u LEFT JOIN s USING (geoid)")
def join_j1_merge_plan(spark, d):
    """The merge plan: a second table by its suggested key, with the report in the notes."""
    x = tracts(spark, d)
    user = x.groupBy(F.col("county").alias("geoid")).agg(F.count(F.lit(1)).alias("visits"))
    second = x.where(~F.col("county").endswith("3")).groupBy(F.col("county").alias("geoid")).agg(F.sum("pop").alias("pop"))
    done = merge.run(spark, user, merge.MergePlan(second=second), merge.Catalog())
    assert done.notes[0].startswith("1:1")
    return done.data.select("geoid", "visits", "pop", "_merge")


@register(f"WITH {TRACTS} SELECT a.geoid, points, pop FROM (SELECT county AS geoid, count(*) AS points FROM tracts GROUP BY county) a LEFT JOIN (SELECT county AS geoid, sum(pop)::BIGINT AS pop FROM tracts GROUP BY county) b USING (geoid)")
def join_j2_counted_and_attached(spark, d):
    x = tracts(spark, d)
    county = x.groupBy(F.col("county").alias("geoid")).agg(F.sum("pop").alias("pop"))
    catalog = merge.Catalog({"county:people": county, "county:income": county.select("geoid")})
    done = merge.run(spark, x.select("geoid"), merge.MergePlan(count="county", attach=["county people"]), catalog, county.select("geoid"))
    return done.data.select("geoid", "points", "pop")


@register(f"SELECT c_custkey AS road, CASE WHEN c_custkey % 3 = 1 THEN 0.25 ELSE 0.75 END AS level, c_custkey % 4 = 0 AS closed FROM customer WHERE c_custkey % 3 > 0")
def join_j18_flows(spark, d):
    """Roads a hundredth of a degree apart; the flow on every third is 100 m off, others run along, one way round or the other."""
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    x, y = (k % 1000) * 0.01, F.floor(k / 1000) * 0.01 - 1
    line = lambda x, y: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((x + i * 0.0005).alias("lon"), y.alias("lat")))
    roads = c.select(k.alias("road"), F.lit(False).alias("oneway"), line(x, y).alias("coords"))
    off = F.when(k % 3 == 0, 0.0009).otherwise(0.0001)
    flow = line(x, y + off)
    flows = c.select(k.alias("flow"), F.when(k % 3 == 1, 0.25).otherwise(0.75).alias("level"), (k % 4 == 0).alias("closure"), F.when(k % 2 == 0, F.reverse(flow)).otherwise(flow).alias("coords"))
    return routes.matched_flows(roads, flows).select("road", "level", "closed")


def _polled(spark, d):
    """Two polls of a feed: what vehicles sent first, and what some of them sent last."""
    f = feed(spark, d)
    ends = f.groupBy("vehicle").agg(F.min_by("k", "seq").alias("a"), F.max_by("k", "seq").alias("b"), F.max_by("kind", "seq").alias("kind"))
    state = ends.select("vehicle", F.col("a").alias("k"), F.lit(0).cast("long").alias("seen_ms"), F.lit(0).alias("missed"), F.lit("add").alias("change"))
    return state, ends.where("kind != 'error'").select("vehicle", F.when(F.col("kind") != "click", F.col("b")).alias("k"))


_POLLED = f"{FEED}, e AS (SELECT vehicle, min_by(k, seq) AS a, max_by(k, seq) AS b, max_by(kind, seq) AS kind FROM feed GROUP BY vehicle)"


@register(f"WITH {_POLLED} SELECT vehicle, CASE WHEN kind IN ('error', 'click') THEN a ELSE b END AS k, CASE WHEN kind = 'error' THEN 'remove' ELSE 'update' END AS change FROM e")
def stream_st4_carried(spark, d):
    """Missing fields are carried forward; what a complete poll lacks goes."""
    state, poll = _polled(spark, d)
    return live.reconciled(state, poll, "vehicle", ["k"], True, 60_000).select("vehicle", "k", "change")


@register(f"WITH {_POLLED} SELECT vehicle, a AS k, 'keep' AS change FROM e")
def stream_st9_empty_poll(spark, d):
    state, poll = _polled(spark, d)
    return live.reconciled(state, poll.where("false"), "vehicle", ["k"], True, 60_000).select("vehicle", "k", "change")


@register(f"WITH {FEED}, s AS (SELECT *, max(k) OVER (PARTITION BY vehicle ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM feed) SELECT seq, CASE WHEN kind <> 'error' AND (held IS NULL OR k > held) THEN 'replace' ELSE 'keep' END AS done FROM s")
def stream_st10_superseded(spark, d):
    """A snapshot is only published if it is complete and newer than what is held."""
    from pyspark.sql import Window as W

    held = F.max("k").over(W.partitionBy("vehicle").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return feed(spark, d).withColumn("held", held).select("seq", lookups.admission(F.col("held"), F.col("k"), F.col("kind") != "error").alias("done"))


@register("SELECT doc_id, strip_accents(lower(substr(text, 1, 0) || lang || 'ÀÉñ')) AS folded FROM documents WHERE lang IS NOT NULL")
def scalar_s3_folded(spark, d):
    return t(spark, d, "documents").where("lang is not null").select("doc_id", text.folded(F.concat(F.lit(" "), "lang", F.lit("ÀÉñ"))).alias("folded"))


@register("SELECT c_custkey, 'Customer ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title FROM customer")
def scalar_s9_title(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.title(F.concat(F.lit("CUSTOMER "), "c_mktsegment")).alias("title"))


@register("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, 7) WHEN 1 THEN 'éé' || substr(p_name, 1, 3) ELSE substr(p_name, 1, 5) END AS prefix FROM part")
def scalar_s13_byte_prefix(spark, d):
    n = F.col("p_partkey") % 3
    x = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat(F.lit("éé"), "p_name")).otherwise(F.concat(F.substring("p_name", 1, 5), F.lit("ßééé€")))
    return t(spark, d, "part").select("p_partkey", text.byte_prefix(x, 7).alias("prefix")).withColumn("prefix", F.when(n == 2, F.substring("prefix", 1, 5)).otherwise(F.col("prefix")))


@register("SELECT o_orderkey, CAST(o_custkey % 25 AS INTEGER) AS first, CAST(o_orderkey % 50 + 0.5 AS DOUBLE) AS pct, 2 AS entries FROM orders")
def scalar_s17_index_list(spark, d):
    x = F.concat(F.col("o_custkey").cast("long") % 25, F.lit(":"), F.col("o_orderkey") % 50, F.lit(".5,3:1"))
    listed = text.index_list(x)
    return t(spark, d, "orders").select("o_orderkey", listed[0]["idx"].alias("first"), listed[0]["pct"].alias("pct"), F.size(listed).alias("entries"))


@register(f"WITH {FEED} SELECT seq, CASE WHEN k = 7 THEN 'unknown' WHEN k * 2 > 120 THEN 'stale' ELSE 'live' END AS state FROM feed")
def scalar_d10_age(spark, d):
    at = F.when(F.col("k") != 7, F.col("ms") - F.col("k") * 2000)
    return feed(spark, d).select("seq", live.freshness(at, F.col("ms")).alias("state"))


@register("SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1996 THEN year(o_orderdate) END AS built FROM orders")
def scalar_d11_past_year(spark, d):
    return t(spark, d, "orders").select("o_orderkey", dates.past_year(F.year("o_orderdate").cast("long"), 1996).alias("built"))


_GREAT = "x AS (SELECT *, radians(lat) AS p, radians(lon) AS l, radians(10.0) AS q, radians(20.0) AS m FROM feed), g AS (SELECT seq, p, l, q, m, 2 * asin(sqrt(pow(sin((q - p) / 2), 2) + cos(p) * cos(q) * pow(sin((m - l) / 2), 2))) AS w FROM x), b AS (SELECT seq, p, l, q, m, sin(0.75 * w) / sin(w) AS a, sin(0.25 * w) / sin(w) AS b FROM g), v AS (SELECT seq, a * cos(p) * cos(l) + b * cos(q) * cos(m) AS x, a * cos(p) * sin(l) + b * cos(q) * sin(m) AS y, a * sin(p) + b * sin(q) AS z FROM b)"


@register(f"WITH {FEED}, {_GREAT} SELECT seq, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon FROM v")
def geo_x5_between(spark, d):
    lat, lon = geo.between("lat", "lon", F.lit(10.0), F.lit(20.0), F.lit(0.25))
    return feed(spark, d).select("seq", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


@register(f"WITH {TRACTS} SELECT geoid, round(lat * 0.2371 + 35, 5) AS lat, round(lon * 0.0831 - 96, 5) AS lon FROM tracts")
def geo_x8_albers(spark, d):
    """Places put through the forward projection here and back by the operator."""
    import math

    p1, p2, p0, radius = *map(math.radians, (29.5, 45.5, 37.5)), 6371007.181
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    r0 = radius * math.sqrt(c - 2 * n * math.sin(p0)) / n
    lat, lon = F.radians(F.col("lat") * 0.2371 + 35), F.radians(F.col("lon") * 0.0831)
    r = radius * F.sqrt(c - 2 * n * F.sin(lat)) / n
    back = shapes.albers_inverse(r * F.sin(n * lon), r0 - r * F.cos(n * lon), 29.5, 45.5, 37.5, -96.0)
    return tracts(spark, d).select("geoid", F.round(back[0], 5).alias("lat"), F.round(back[1], 5).alias("lon"))


@register(f"WITH {TRACTS} SELECT geoid, round(lat * 0.02371 + 42, 5) AS lat, round(lon * 0.01661 - 71.5, 5) AS lon FROM tracts")
def geo_x9_lambert(spark, d):
    import math

    a, e = shapes.GRS80
    p1, p2, p0 = map(math.radians, (41.716666666667, 42.683333333333, 41.0))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    ts = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(ts(p1)) - math.log(ts(p2)))
    big = m(p1) / (n * ts(p1) ** n)
    lat, lon = F.radians(F.col("lat") * 0.02371 + 42), F.radians(F.col("lon") * 0.01661)
    s = e * F.sin(lat)
    tt = F.tan(math.pi / 4 - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    r, r0 = a * big * F.pow(tt, F.lit(n)), a * big * ts(p0) ** n
    back = shapes.lambert_inverse(r * F.sin(n * lon) + 200_000, r0 - r * F.cos(n * lon) + 750_000, 41.716666666667, 42.683333333333, 41.0, -71.5, 200_000.0, 750_000.0)
    return tracts(spark, d).select("geoid", F.round(back[0], 5).alias("lat"), F.round(back[1], 5).alias("lon"))


@register(f"WITH {FEED} SELECT seq, round((lon * 3 + 180 + 1080) % 360 - 180, 5) AS lon FROM feed")
def geo_x11_wrapped(spark, d):
    return feed(spark, d).select("seq", F.round(geo.wrap_lon(F.col("lon") * 3), 5).alias("lon"))


@register("SELECT l_orderkey, l_linenumber, round(l_quantity * (1 - l_discount) * (1 - l_tax) + l_partkey * l_discount * (1 - l_tax) + l_suppkey * (1 - l_discount) * l_tax + l_linenumber * l_discount * l_tax, 4) AS v FROM lineitem")
def geo_x14_bilinear(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(geo.bilinear("l_quantity", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"), 4).alias("v"))


@register(f"WITH {TRACTS} SELECT geoid, 11 AS points, round(lat / 2 + 10 * 10.0 * 600 / 111195.0, 5) AS lat FROM tracts")
def geo_x15_streamlines(spark, d):
    """Ten steps of ten minutes in a wind of 10 m/s from the south."""
    path = F.pandas_udf(lambda x, y: pd.Series([[p[1] for p in shapes.streamline(lambda a, b: 0.0, lambda a, b: 10.0, i, j, 10, 600.0)] for i, j in zip(x, y)]), "array<double>")
    p = tracts(spark, d).select("geoid", path(F.col("lon").cast("double"), F.col("lat") / 2).alias("p"))
    return p.select("geoid", F.size("p").alias("points"), F.round(F.element_at("p", -1), 5).alias("lat"))


@register(f"WITH {FEED} SELECT seq, round(k * 0.3048, 4) AS metres, round(k * 0.514444, 4) AS mps, round(k * 0.00508, 6) AS climb FROM feed")
def geo_x17_units(spark, d):
    k = F.col("k")
    return feed(spark, d).select("seq", F.round(k * geo.FOOT, 4).alias("metres"), F.round(k * geo.KNOT, 4).alias("mps"), F.round(k * geo.FOOT_A_MINUTE, 6).alias("climb"))


def _km(a: str, b: str, c: str, e: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2)))"


@register(f"WITH {FEED} SELECT seq, round({_km('lat', 'lon', 'lat + 1', 'lon')} + {_km('lat', 'lon', 'lat', 'lon + 2')}, 4) AS km FROM feed")
def geo_x18_manhattan(spark, d):
    return feed(spark, d).select("seq", F.round(geo.manhattan("lat", "lon", F.col("lat") + 1, F.col("lon") + 2), 4).alias("km"))


def _ring(*points):
    return F.array(*(F.struct((F.col("lon") + x).cast("double").alias("x"), (F.col("lat") + y).cast("double").alias("y")) for x, y in points))


@register(f"WITH {TRACTS} SELECT geoid, 4 AS corners, round(lon, 5) AS x FROM tracts")
def array_a4_hull(spark, d):
    """Hull of a square with points inside and on its sides."""
    h = scratch.dealt(tracts(spark, d).select("geoid", "lon", "lat")).select("geoid", shapes.hull_udf(_ring((0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0), (0.5, 1.5))).alias("h"))
    return h.select("geoid", F.size("h").alias("corners"), F.round(F.col("h")[0]["x"], 5).alias("x"))


@register(f"WITH {TRACTS} SELECT geoid, 3 AS segment, 3 AS infinite FROM tracts")
def array_a5_simplified(spark, d):
    """A bend stays; a point within the tolerance goes."""
    line = _ring((0, 0), (1, 0.01), (2, 0), (3, 1))
    s = scratch.dealt(tracts(spark, d).select("geoid", "lon", "lat")).select("geoid", shapes.simplify_udf(line, 0.1).alias("a"), shapes.simplify_udf(line, 0.1, True).alias("b"))
    return s.select("geoid", F.size("a").alias("segment"), F.size("b").alias("infinite"))


@register(f"WITH {TRACTS} SELECT geoid, CASE WHEN k % 2 = 0 THEN 4 ELSE 0 END AS points FROM tracts")
def array_a6_cleaned(spark, d):
    ring = F.when(F.col("k") % 2 == 0, _ring((0, 0), (0, 0), (1, 0), (1, 1), (1, 1))).otherwise(_ring((0, 0), (1, 1), (0, 0)))
    return scratch.dealt(tracts(spark, d).select("geoid", "k", "lon", "lat")).select("geoid", F.size(shapes.clean_udf(ring)).alias("points"))


@register(f"WITH {TRACTS} SELECT geoid, round(lon + 1, 5) AS x, round(lat + 0.5, 5) AS y FROM tracts")
def array_a7_centroid(spark, d):
    x, y = geo.ring_centroid("ring")
    return tracts(spark, d).withColumn("ring", _ring((0, 0), (2, 0), (2, 1), (0, 1))).select("geoid", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@register(f"WITH {TRACTS} SELECT geoid, 2 AS parts FROM tracts")
def array_a8_clipped(spark, d):
    """A line that leaves a box and comes back."""

    def parts(lon, lat):
        return pd.Series([len(shapes.clipped([(x, y), (x, y + 3), (x + 1, y + 3), (x + 1, y)], x - 1, y - 1, x + 2, y + 2)) for x, y in zip(lon, lat)])

    return tracts(spark, d).select("geoid", F.pandas_udf(parts, "int")(F.col("lon").cast("double"), "lat").alias("parts"))


@register(f"WITH {TRACTS} SELECT geoid, row_number() OVER (PARTITION BY county ORDER BY geoid) AS line FROM tracts")
def scan_s3_chunk_order(spark, d):
    return layers.numbered(tracts(spark, d), "county", "geoid").select("geoid", "line")


@register("WITH s AS (SELECT c_custkey % 25 AS g, count(*) AS n, avg(c_acctbal) AS y, avg(c_custkey) AS x FROM customer GROUP BY 1) SELECT 'x' AS term, round(regr_slope(y, x), 6) AS coef FROM s UNION ALL SELECT '_cons', round(regr_intercept(y, x), 4) FROM s")
def stat_a28_centred(spark, d):
    g = t(spark, d, "customer").groupBy((F.col("c_custkey") % 25).alias("g")).agg(F.avg("c_acctbal").alias("y"), F.avg("c_custkey").alias("x"))
    fit = stats.least_squares(g, "y", ["x"])
    rows = [(n, round(float(c), 6 if n == "x" else 4)) for n, c in zip(fit["term"], fit["coef"])]
    return spark.createDataFrame(rows, "term string, coef double")


@register("WITH r AS (SELECT n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT chr(65279) || 'rank,nation,n' AS line UNION ALL SELECT rank || ',' || n_nationkey || ',' || n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, n_nationkey) AS rank FROM r) WHERE rank <= 10")
def report_t1_printed(spark, d):
    """A report planned, ranked and printed as CSV."""
    n = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    plan = report.planned({"rank_by": "n", "limit": 10, "columns": ["nation", "n"]}, ["nation", "n"])
    header, body = report.table(report.ranked(n, plan, "nation"), plan, {"n": "text", "nation": "text"})
    lines = report.csv(header, body).decode().split("\r\n")[:-1]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@register(f"WITH {TRACTS} SELECT geoid FROM tracts WHERE geoid LIKE '03%'")
def filter_f1_state(spark, d):
    return layers.pruned(tracts(spark, d), state="03").select("geoid")


@register("SELECT o_custkey FROM orders WHERE year(o_orderdate) IN (1993, 1995, 1997) AND o_totalprice >= 1000 GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) = 3")
def filter_f9_present_in_all_periods(spark, d):
    o = t(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return aggregates.in_all_periods(o, "o_custkey", "year", [1993, 1995, 1997], F.col("o_totalprice"), 1000)


@register("WITH p AS (SELECT l_suppkey AS point, l_partkey % 40 AS address, l_orderkey, l_linenumber FROM lineitem), s AS (SELECT point FROM p GROUP BY point HAVING count(*) >= 10 AND count(DISTINCT address) >= 30) SELECT l_orderkey, l_linenumber FROM p WHERE point NOT IN (SELECT point FROM s)")
def filter_f10_stacked_points(spark, d):
    p = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("point"), (F.col("l_partkey") % 40).alias("address"), "l_orderkey", "l_linenumber")
    return aggregates.without_stacks(p, ["point"], "address", 10, 30).select("l_orderkey", "l_linenumber")


@register("SELECT l_orderkey, l_linenumber, upto FROM (SELECT *, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM lineitem) WHERE upto <= 100")
def filter_f12_vertex_budget(spark, d):
    rows = t(spark, d, "lineitem").withColumn("points", F.col("l_quantity").cast("long"))
    return aggregates.within_budget(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "points", 100).select("l_orderkey", "l_linenumber", F.col("used").alias("upto"))


@register("SELECT p_partkey FROM part WHERE p_type NOT LIKE 'SMALL%' AND p_size > 3")
def filter_f23_excluded_layers(spark, d):
    return layers.without(t(spark, d, "part"), F.element_at(F.split("p_type", " "), 1), ["SMALL"], F.col("p_size") > 3)[0].select("p_partkey")


@register(f"WITH {FEED} SELECT seq FROM (SELECT seq, max(used > 200) OVER (PARTITION BY vehicle ORDER BY seq) AS over FROM (SELECT *, sum(k) OVER (PARTITION BY vehicle ORDER BY seq) AS used FROM feed)) WHERE NOT over")
def window_w7_budget(spark, d):
    return aggregates.within_budget(feed(spark, d), ["vehicle"], ["seq"], "k", 200).select("seq")


@register(f"WITH {FEED} SELECT strftime(make_timestamp(ms // 86400000 * 86400000000), '%Y-%m-%d') AS day, kind, count(DISTINCT vehicle) AS granules FROM feed GROUP BY 1, 2")
def set_u6_days(spark, d):
    return feed(spark, d).select(dates.utc_day("ms").alias("day"), "kind", "vehicle").distinct().groupBy("day", "kind").agg(F.count(F.lit(1)).alias("granules"))


@register(f"WITH {FEED}, s AS (SELECT vehicle, ms > lag(ms) OVER (PARTITION BY vehicle ORDER BY seq) AS up FROM feed) SELECT vehicle, coalesce(bool_and(up), true) AS rising, count(*) AS n FROM s GROUP BY vehicle")
def scan_s43_rising_times(spark, d):
    return aggregates.rising(feed(spark, d), "vehicle", "ms", "seq")


@register("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def join_j24_semi(spark, d):
    """Suppliers of a region, two thirds of them by code and the others by their country's name."""
    n = t(spark, d, "nation")
    area = n.select(F.col("n_regionkey").cast("string").alias("code"), F.col("n_name").alias("area"))
    rows = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("n_regionkey").cast("string")).alias("code"), F.concat(F.lit(" "), F.upper("n_name")).alias("country"))
    return joins.by_code_or_name(rows, area, "code", text.folded("country"), text.folded("area"), ["2"]).select("s_suppkey")


@register("SELECT s_suppkey, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN n_name END, 'unnamed') AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def join_j14_feed_defaults(spark, d):
    seeds = t(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label"))
    return joins.with_defaults(t(spark, d, "supplier"), seeds, "s_nationkey", {"label": F.lit("unnamed")}).select("s_suppkey", "label")


_STATES = "['unavailable', 'loading', 'degraded', 'stale', 'fallback', 'partial', 'nominal', 'off']"


@register(f"WITH {TRACTS} SELECT county, {_STATES}[min(1 + k % 7)::INT] AS state FROM tracts GROUP BY county")
def stream_st15_provenance(spark, d):
    """The worst state of several sources."""
    state = F.element_at(F.array(*map(F.lit, records.SEVERITY)), (1 + F.col("k") % 7).cast("int"))
    return tracts(spark, d).select("county", state.alias("state")).groupBy("county").agg(records.worst_state("state").alias("state"))


@register("SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS n FROM customer")
def scalar_s8_id_from_text(spark, d):
    prefix = F.regexp_extract("c_name", "^(.*?)0*[0-9]+$", 1)
    return t(spark, d, "customer").select("c_custkey", text.id_after(F.concat(F.lit("area-"), F.regexp_extract("c_name", "([0-9]+)$", 1)), "area-").alias("n")).where(prefix.isNotNull())


@register("SELECT o_orderkey, CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade FROM orders")
def scalar_d8_decade(spark, d):
    return t(spark, d, "orders").select("o_orderkey", dates.decade("o_orderdate").alias("decade"))


@register("SELECT c_custkey, c_custkey AS number, CASE WHEN c_custkey % 2 = 0 THEN 'W' END AS dir, upper(c_mktsegment) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'AVE' ELSE 'ST' END AS type, upper(c_mktsegment) AS a, '12TH' AS b FROM customer")
def scalar_s14_addresses(spark, d):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, F.when(k % 2 == 0, "Av.").otherwise("Ave")).otherwise("St.")
    address = text.street_address(F.concat(k.cast("string"), F.lit(" "), F.when(k % 2 == 0, "W. ").otherwise(""), "c_mktsegment", F.lit(" "), kind))
    corner = text.street_corner(F.concat("c_mktsegment", F.when(k % 2 == 0, " St. and 12th St.").otherwise(" & 12th sts.")))
    return t(spark, d, "customer").select("c_custkey", address.alias("x"), corner.alias("y")).select("c_custkey", "x.number", "x.dir", "x.name", "x.type", "y.a", "y.b")


@register(f"SELECT l_orderkey AS route, l_linenumber - CASE WHEN l_linenumber > 3 AND n > 3 THEN 1 ELSE 0 END AS step, CASE WHEN l_linenumber = 3 AND n > 3 THEN l_quantity + nxt ELSE l_quantity END AS metres FROM (SELECT l_orderkey, l_quantity, row_number() OVER w AS l_linenumber, lead(l_quantity) OVER w AS nxt, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE l_linenumber <> 4")
def project_p28_route_steps(spark, d):
    """Orders as routes of two legs; the third step enters a roundabout that the fourth leaves."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("metres"))
    steps = F.transform(F.array_sort(F.collect_list(line)), lambda s, i: F.struct(F.when(i == 2, "roundabout").when(i == 3, "exit roundabout").otherwise("turn").alias("kind"), s["l_partkey"].cast("string").alias("name"), s["metres"].alias("metres")))
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(steps.alias("s"))
    legs = F.array(F.slice("s", 1, 2), F.slice("s", 3, F.greatest(F.size("s") - 2, F.lit(0))))
    return routes.route_steps(lines.select(F.col("l_orderkey").alias("route"), legs.alias("legs")), most=None).select("route", "step", "metres")


@register(f"WITH {TRACTS} SELECT state AS chunk, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS areas FROM tracts GROUP BY state")
def agg_a12_chunk_boxes(spark, d):
    return layers.index(tracts(spark, d), "state")


def _field(spark, d):
    """A global field of 36 by 19 cells, from what orders of that many kinds cost on average."""
    n = F.col("o_orderkey") % 684
    cells = t(spark, d, "orders").groupBy(n.alias("n")).agg(F.avg("o_totalprice").alias("v"))
    return spark.range(684).join(cells, F.col("id") == F.col("n"), "left").select((F.col("id") % 36).cast("int").alias("ix"), F.floor(F.col("id") / 36).cast("int").alias("iy"), F.coalesce("v", F.lit(0.0)).alias("v"))


@register(f"WITH {TRACTS}, c AS (SELECT o_orderkey % 684 AS n, avg(o_totalprice) AS v FROM orders GROUP BY 1), g AS (SELECT CAST(i % 36 AS INTEGER) AS ix, CAST(i // 36 AS INTEGER) AS iy, coalesce(v, 0) AS v FROM (SELECT unnest(range(684)) AS i) LEFT JOIN c ON i = n), p AS (SELECT geoid, pop, (lon + 180) / 10 AS gx, (lat + 90) / 10 AS gy FROM tracts), q AS (SELECT *, CAST(floor(gx) AS INTEGER) AS x0, CAST(floor(gy) AS INTEGER) AS y0, CAST(floor(gx) + 1 AS INTEGER) % 36 AS x1, least(CAST(floor(gy) + 1 AS INTEGER), 18) AS y1 FROM p) SELECT geoid, round(pop + a.v * (1 - (gx - x0)) * (1 - (gy - y0)) + b.v * (gx - x0) * (1 - (gy - y0)) + e.v * (1 - (gx - x0)) * (gy - y0) + f.v * (gx - x0) * (gy - y0), 2) AS height FROM q JOIN g a ON a.ix = x0 AND a.iy = y0 JOIN g b ON b.ix = x1 AND b.iy = y0 JOIN g e ON e.ix = x0 AND e.iy = y1 JOIN g f ON f.ix = x1 AND f.iy = y1")
def geo_x16_geoid(spark, d):
    points = tracts(spark, d).select("geoid", "lat", F.col("lon").cast("double").alias("lon"), "pop")
    return grids.ellipsoid_heights(points, _field(spark, d), 36, 19, "pop").select("geoid", F.round("ellipsoid_height", 2).alias("height"))


@register("WITH c AS (SELECT o_orderkey % 684 AS n, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT CAST(i % 36 AS INTEGER) AS ix, CAST(i // 36 AS INTEGER) AS iy, coalesce(v, 0) AS v, coalesce(v, 0) * 2 AS gust, 'rain' AS left_out FROM (SELECT unnest(range(684)) AS i) LEFT JOIN c ON i = n")
def grid_g3_companions(spark, d):
    """A field with one companion on its cells, and one that is left out because it lacks some."""
    main = _field(spark, d)
    whole, out = grids.with_companions(main, {"gust": main.withColumn("v", F.col("v") * 2), "rain": main.where("ix < 30")})
    return whole.withColumn("left_out", F.lit(",".join(out)))


@register(f"WITH {FEED} SELECT seq, CASE WHEN lon BETWEEN -125 AND -66.9 AND lat BETWEEN 24.3 AND 49.5 THEN 'conus' WHEN (lon >= 172 OR lon <= -129.9) AND lat BETWEEN 51 AND 71.5 THEN 'alaska' WHEN lon BETWEEN -160.6 AND -154.7 AND lat BETWEEN 18.8 AND 22.4 THEN 'hawaii' WHEN lon BETWEEN -68 AND -64.5 AND lat BETWEEN 17.6 AND 18.6 THEN 'puerto rico' END AS part FROM feed")
def scan_s39_us_boxes(spark, d):
    return feed(spark, d).select("seq", geo.us_box("lat", "lon").alias("part"))


@register("SELECT p_partkey, p_name FROM part")
def scan_s46_first_readable(spark, d):
    """Today's file is not there, so yesterday's is read."""
    path, df = feeds.first_readable(spark, [f"{d}/part_of_today.parquet", f"{d}/part.parquet"], "parquet")
    assert path.endswith("/part.parquet")
    return df.select("p_partkey", "p_name")


@register("SELECT o_custkey % 50 AS query, o_orderkey AS objectid, o_totalprice AS v FROM orders")
def scan_s32_object_pages(spark, d):
    """Pages of a hundred objects that overlap; of each object one stays."""
    o = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("query"), F.struct(F.col("o_orderkey").alias("objectid"), F.col("o_totalprice").alias("v")).alias("r"))
    paged = o.withColumn("page", F.explode(F.array(F.floor(F.col("r.objectid") / 100), F.floor(F.col("r.objectid") / 100) + 1)))
    pages = paged.groupBy("query", "page").agg(F.collect_list("r").alias("rows"), F.lit(True).alias("more"))
    return places.pages_until_done(pages, "objectid", most=None)


@register("SELECT o_orderkey AS objectid, o_totalprice AS v FROM orders")
def scan_s32_paged_reader(spark, d):
    """Orders as the answers of a paged service, a folder a page, read again by as many tasks as shuffles have, page by page."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("objectid"), F.col("o_totalprice").alias("v"), F.lit(1).cast("long").alias("one"))
    placed = scratch.written(scratch.prefix_sums(o, "objectid", "one").withColumn("at", F.col("upto") - 1))
    size = 1000
    row = F.struct("at", F.to_json(F.struct("objectid", "v")).alias("j"))
    answers = placed.groupBy((F.floor(F.col("at") / size) * size).alias("offset")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    body = F.concat(F.lit('{"features":['), F.array_join(F.transform("r", lambda x: F.concat(F.lit('{"attributes":'), x["j"], F.lit("}"))), ","), F.lit("]}"))
    folder = f"{shared(spark)}/pages/{uuid.uuid4().hex}"
    answers.select("offset", body.alias("value")).write.partitionBy("offset").text(folder)
    uri = folder if "://" in folder else folder.replace("file:", "file://") if folder.startswith("file:") else f"file://{folder}"
    return paged.objects(spark, uri + "/offset={offset}", "objectid long, v double", "objectid", count=placed.count(), page=size, at_once=spark.conf.get("spark.sql.shuffle.partitions"))


@register("SELECT o_orderkey, CAST(o_orderkey % 90 AS DOUBLE) AS west, CAST(o_orderkey % 90 + CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS east FROM orders")
def array_a13_footprints(spark, d):
    """Footprints picked from either of two places of an answer: a polygon, else a bounding rectangle."""
    k = F.col("o_orderkey")
    x = k % 90
    corner = lambda dx, dy: F.concat(F.lit('{"Longitude":'), (x + dx).cast("string"), F.lit(f',"Latitude":{dy}}}'))
    polygon = F.concat(F.lit('"GPolygons":[{"Boundary":{"Points":['), F.concat_ws(",", corner(0, 1), corner(2, 1), corner(2, 3)), F.lit("]}}]"))
    box = F.concat(F.lit('"BoundingRectangles":[{"WestBoundingCoordinate":'), x.cast("string"), F.lit(',"EastBoundingCoordinate":'), (x + 1).cast("string"), F.lit(',"SouthBoundingCoordinate":1,"NorthBoundingCoordinate":2}]'))
    item = F.concat(F.lit('{"meta":{"concept-id":"'), k.cast("string"), F.lit('"},"umm":{"TemporalExtent":{"RangeDateTime":{"BeginningDateTime":"2024-01-02T00:00:00Z"}},"SpatialExtent":{"HorizontalSpatialDomain":{"Geometry":{'), F.when(k % 2 == 0, polygon).otherwise(box), F.lit("}}}}}"))
    pages = t(spark, d, "orders").select(k.alias("search"), F.lit(0).alias("page"), F.lit(None).cast("string").alias("cursor"), F.concat(F.lit('{"hits":1,"items":['), item, F.lit("]}")).alias("value"))
    found = places.granules(pages)
    xs = F.transform("ring", lambda p: p["x"])
    return found.select(F.col("search").alias("o_orderkey"), F.array_min(xs).alias("west"), F.array_max(xs).alias("east"))


@register()
def stream_st6_motion(spark, d):
    """What became of each vehicle's last fix: on its path, waiting for a second one that agrees, or a path begun anew."""
    f = feed(spark, d).select(F.col("vehicle").alias("key"), "ms", F.col("lat"), F.col("lon").cast("double").alias("lon"), F.col("kind").alias("trip"))
    return live.history_batch(f).select("key", "motion")
