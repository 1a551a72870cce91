"""Registered scalar functions, geometry and grids over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import dates, geo, text
from geoloom.plans.base import FEED, TRACTS, feed, t, tracts
from geoloom.plans.registry import register


@register("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(p_name || ' & Saint (x) Mount''s'), '&', ' and '), '\\([^)]*\\)', ' ', 'g'), '[''’.]', '', 'g'), '\\bsaint\\b', 'st', 'g'), '[^a-z0-9/-]+', ' ', 'g')) AS name FROM part")
def scalar_s1_place_name(spark, d):
    return t(spark, d, "part").select("p_partkey", text.place_name(F.concat("p_name", F.lit(" & Saint (x) Mount's"))).alias("name"))


@register("SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS id FROM customer")
def scalar_s2_canonical_id(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.canonical_id("c_name").alias("id"))


@register("SELECT c_custkey, substr('v' || (c_custkey % 7) || '_' || regexp_replace(lower(c_name), '[^a-z0-9_]+', '_', 'g'), 1, 28) AS name FROM customer")
def scalar_s5_variable_name(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.variable_name(F.concat((F.col("c_custkey") % 7).cast("string"), F.lit(" "), "c_name")).alias("name"))


@register("SELECT c_custkey, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey")
def scalar_s6_suffix(spark, d):
    j = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.element_at(F.array(F.lit(" city"), F.lit(" town"), F.lit(" CDP"), F.lit(" village (balance)")), (F.col("c_custkey") % 4).cast("int") + 1)
    return j.select("c_custkey", text.without_suffix(F.concat("n_name", kind)).alias("place"))


@register("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def scalar_s7_slug(spark, d):
    return t(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@register("SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title FROM pages")
def scalar_s10_entities(spark, d):
    return t(spark, d, "pages").select("page_id", text.decoded(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


@register("SELECT doc_id, nullif(substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' '), 1, 60), '') AS head FROM documents")
def scalar_s11_clean(spark, d):
    return t(spark, d, "documents").select("doc_id", text.clean("text", 60).alias("head"))


@register("SELECT p_partkey, CAST(CASE WHEN p_partkey % 700 >= 26 THEN (p_partkey % 700 // 26) * 26 + p_partkey % 26 + CASE WHEN p_partkey % 700 % 26 = p_partkey % 26 THEN 0 ELSE p_partkey % 700 % 26 - p_partkey % 26 END ELSE p_partkey % 700 END AS INT) AS col FROM part")
def scalar_s12_column_ref(spark, d):
    n = F.col("p_partkey") % 700
    letter = lambda c: F.char(c + 65)
    ref = F.concat(F.when(n >= 26, letter(F.floor(n / 26) - 1)).otherwise(""), letter(n % 26), (F.col("p_size")).cast("string"))
    return t(spark, d, "part").select("p_partkey", text.column_index(ref).alias("col"))


@register("SELECT o_orderkey, CAST(o_orderkey % 90 AS DOUBLE) AS lat, CAST(o_custkey % 180 AS DOUBLE) AS lon FROM orders")
def scalar_s15_coordinates(spark, d):
    q = F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(", "), (F.col("o_custkey") % 180).cast("string"))
    return t(spark, d, "orders").select("o_orderkey", text.coordinates(q).alias("p")).select("o_orderkey", "p.lat", "p.lon")


@register("SELECT n_nationkey, CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: ((xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 16777619) % 4294967296)) AS BIGINT) AS h FROM nation")
def scalar_s16_fnv(spark, d):
    return t(spark, d, "nation").select("n_nationkey", text.fnv1a("n_name").alias("h"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN s < 60 THEN s || ' s' WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || ' min' ELSE '' END END AS shown FROM (SELECT *, CAST(round(s / 60.0) AS BIGINT) AS m FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * l_quantity * 5 AS BIGINT) AS s FROM lineitem))")
def scalar_s18_duration(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.duration(F.col("l_quantity") * F.col("l_quantity") * 5).alias("shown"))


@register("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem")
def scalar_d1_short_date(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dates.short_date(F.date_format("l_shipdate", "M/d/yyyy")).cast("string").alias("day"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def scalar_d2_month_day(spark, d):
    code = F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", dates.month_day(code, F.year("o_orderdate")).cast("string").alias("day"))


@register("SELECT event_id, CAST(epoch_us(ts) // 60000000 * 60000 AS BIGINT) AS ms FROM events")
def scalar_d3_acquired(spark, d):
    ts = F.col("ts").cast("timestamp")
    at = dates.acquired(F.date_format(ts, "yyyy-MM-dd"), F.hour(ts) * 100 + F.minute(ts))
    return t(spark, d, "events").select("event_id", F.unix_millis(at).alias("ms"))


@register("SELECT event_id, CAST(epoch_us(ts) // 1000000 * 1000 AS BIGINT) AS ms FROM events")
def scalar_d4_compact(spark, d):
    at = dates.compact(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'"))
    return t(spark, d, "events").select("event_id", F.unix_millis(at).alias("ms"))


@register("SELECT l_orderkey, l_linenumber, CAST(l_quantity * 60 + l_linenumber AS BIGINT) AS seconds FROM lineitem")
def scalar_d5_clock(spark, d):
    shown = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dates.clock_seconds(shown).alias("seconds"))


@register(f"WITH {FEED} SELECT seq, CASE WHEN k % 3 = 0 THEN CAST(floor(ms / 1000) * 1000 AS BIGINT) WHEN k % 3 = 1 THEN ms END AS ms FROM feed")
def scalar_d6_epoch(spark, d):
    raw = F.when(F.col("k") % 3 == 0, F.floor(F.col("ms") / 1000)).when(F.col("k") % 3 == 1, F.col("ms")).otherwise(12345)
    return feed(spark, d).select("seq", dates.epoch_ms(raw).alias("ms"))


@register("SELECT year(o_orderdate) AS year, (year(o_orderdate) // 5 * 5) || '-' || (year(o_orderdate) // 5 * 5 + 4) AS block, count(*) AS n FROM orders GROUP BY 1, 2")
def scalar_d7_block(spark, d):
    y = F.year("o_orderdate").cast("long")
    return t(spark, d, "orders").groupBy(y.alias("year")).agg(F.count(F.lit(1)).alias("n")).select("year", dates.block_label("year").alias("block"), "n")


@register("SELECT l_orderkey, l_linenumber, CAST((l_quantity * 3600 + l_linenumber * 60 + 5) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DOUBLE) AS seconds FROM lineitem")
def scalar_d13_duration(spark, d):
    iso = F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise(""), F.lit("PT"), F.col("l_quantity").cast("int").cast("string"), F.lit("H"), F.col("l_linenumber").cast("string"), F.lit("M5S"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dates.iso_duration(iso).alias("seconds"))


@register(f"WITH {TRACTS} SELECT geoid, round(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(lat - 48.85) / 2), 2) + cos(radians(48.85)) * cos(radians(lat)) * pow(sin(radians(lon - 2.35) / 2), 2)))), 4) AS km, round(fmod(degrees(atan2(sin(radians(lon - 2.35)) * cos(radians(lat)), cos(radians(48.85)) * sin(radians(lat)) - sin(radians(48.85)) * cos(radians(lat)) * cos(radians(lon - 2.35)))) + 360, 360), 5) AS bearing FROM tracts")
def geo_x1_x3_distance(spark, d):
    at = (F.lit(48.85), F.lit(2.35), "lat", "lon")
    return tracts(spark, d).select("geoid", F.round(geo.haversine(*at), 4).alias("km"), F.round(geo.bearing(*at), 5).alias("bearing"))


@register(f"WITH {TRACTS} SELECT geoid, round(6371000 * sqrt(pow(radians(lon - 10) * cos(radians((lat + 20) / 2)), 2) + pow(radians(lat - 20), 2)), 2) AS metres FROM tracts")
def geo_x2_flat_distance(spark, d):
    return tracts(spark, d).select("geoid", F.round(geo.flat_distance(F.lit(20.0), F.lit(10.0), "lat", "lon"), 2).alias("metres"))


@register(f"WITH {TRACTS}, x AS (SELECT geoid, lon, radians(lat) AS p, 100.0 / 6371 AS s FROM tracts) SELECT geoid, round(degrees(asin(sin(p) * cos(s) + cos(p) * sin(s) * cos(radians(45)))), 6) AS lat FROM x")
def geo_x4_destination(spark, d):
    lat, _ = geo.destination("lat", "lon", F.lit(45.0), F.lit(100.0), geo.KM)
    return tracts(spark, d).select("geoid", F.round(lat, 6).alias("lat"))


@register(f"WITH {TRACTS} SELECT geoid, CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS x, CAST(round(floor((lon + 180) / 360 * 1024) / 1024 * 360 - 180, 6) AS DOUBLE) AS west FROM tracts")
def geo_x7_tiles(spark, d):
    x = geo.tile_x("lon", 10)
    return tracts(spark, d).select("geoid", x.cast("long").alias("x"), F.round(geo.tile_lon(x.cast("double"), 10), 6).alias("west"))


@register(f"WITH {TRACTS} SELECT geoid, floor(lon / 2.5) * 2.5 AS west, ceil(lon / 2.5) * 2.5 AS east FROM tracts")
def geo_x10_snap(spark, d):
    west, east = geo.snap_out("lon", "lon", 2.5)
    return tracts(spark, d).select("geoid", west.alias("west"), east.alias("east"))


@register(f"WITH {FEED} SELECT seq, round(sqrt(pow(k - 50, 2) + pow(speed, 2)), 5) AS speed, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor(fmod(degrees(atan2(50 - k, -speed)) + 360, 360) / 22.5 + 0.5) AS INT) % 16 + 1] AS point FROM feed")
def geo_x13_wind(spark, d):
    speed, way = geo.wind((F.col("k") - 50).cast("double"), "speed")
    return feed(spark, d).select("seq", F.round(speed, 5).alias("speed"), geo.compass(way).alias("point"))


@register("SELECT l_orderkey, round(sum(x * y2 - x2 * y) / 2, 4) AS area FROM (SELECT l_orderkey, l_quantity AS x, l_linenumber * 1.0 AS y, coalesce(lead(l_quantity) OVER w, first_value(l_quantity) OVER w) AS x2, coalesce(lead(l_linenumber) OVER w, first_value(l_linenumber) OVER w) * 1.0 AS y2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) GROUP BY l_orderkey")
def array_a2_ring_area(spark, d):
    point = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    r = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("ring"))
    return r.select("l_orderkey", F.round(geo.ring_area("ring"), 4).alias("area"))


@register(f"WITH {TRACTS} SELECT geoid, lon > -60 AND lon <= 60 AND lat > -20 AND lat <= 50 AND NOT (lon - lat > 60) AS inside FROM tracts WHERE abs(lon - lat - 60) > 0.001")
def array_a3_point_in_ring(spark, d):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-60, -20), (40, -20), (60, 0), (60, 50), (-60, 50))))
    return tracts(spark, d).where("abs(lon - lat - 60) > 0.001").select("geoid", geo.in_ring("lon", "lat", ring).alias("inside"))


@register("SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS INT) AS kinds FROM orders GROUP BY o_custkey")
def array_a11_distinct_slice(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.size(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 24)).alias("kinds"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def array_a12_variant_path(spark, d):
    return t(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@register("SELECT c_custkey, c_mktsegment AS leaf FROM customer")
def array_a14_label_path(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.label_path(F.concat_ws("!!", F.lit("Total"), "c_name", "c_mktsegment")).alias("leaf"))


def _grid(spark, d):
    """A 36 x 18 field of the feed: mean value of each 10 degree cell, 0 where there is none."""
    f = feed(spark, d).groupBy(F.floor((F.col("lon") + 180) / 10).cast("int").alias("ix"), F.floor((F.col("lat") + 90) / 10).cast("int").alias("iy")).agg(F.avg("k").alias("v"))
    cells = spark.range(36 * 18).select((F.col("id") % 36).cast("int").alias("ix"), F.floor(F.col("id") / 36).cast("int").alias("iy"))
    return cells.join(f, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("v", F.lit(0.0)).alias("v"))


_GRID = f"{FEED}, f AS (SELECT CAST(floor((lon + 180) / 10) AS INT) AS ix, CAST(floor((lat + 90) / 10) AS INT) AS iy, avg(k) AS v FROM feed GROUP BY 1, 2), grid AS (SELECT ix, iy, coalesce(v, 0.0) AS v FROM (SELECT ix, iy FROM (SELECT unnest(range(36))::INT AS ix), (SELECT unnest(range(18))::INT AS iy)) c LEFT JOIN f USING (ix, iy))"


@register(f"""WITH {_GRID}, want AS (SELECT x, y, x / 2.0 AS gx, least(y / 2.0, 17.0) AS gy FROM (SELECT unnest(range(72)) AS x), (SELECT unnest(range(36)) AS y)),
w AS (SELECT *, CAST(floor(gx) AS INT) AS x0, (CAST(floor(gx) AS INT) + 1) % 36 AS x1, CAST(floor(gy) AS INT) AS y0, least(CAST(floor(gy) AS INT) + 1, 17) AS y1 FROM want)
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(a.v * (1 - gx + x0) * (1 - gy + y0) + b.v * (gx - x0) * (1 - gy + y0) + c.v * (1 - gx + x0) * (gy - y0) + e.v * (gx - x0) * (gy - y0), 6) AS v
FROM w JOIN grid a ON a.ix = x0 AND a.iy = y0 JOIN grid b ON b.ix = x1 AND b.iy = y0 JOIN grid c ON c.ix = x0 AND c.iy = y1 JOIN grid e ON e.ix = x1 AND e.iy = y1""")
def grid_g1_resample(spark, d):
    from geoloom.operators.grids import resample

    return resample(_grid(spark, d), 36, 18, 72, 36).select("x", "y", F.round("v", 6).alias("v"))


@register(f"WITH {_GRID} SELECT ix, iy, round(v + 273.15 - 273.15, 6) AS celsius, round(v * 100 / 100, 6) AS hpa FROM grid")
def grid_g2_units(spark, d):
    from geoloom.operators.grids import converted

    k = _grid(spark, d).select("ix", "iy", (F.col("v") + 273.15).alias("temperature"), (F.col("v") * 100).alias("pressure"))
    return converted(k).select("ix", "iy", F.round("celsius", 6).alias("celsius"), F.round("hpa", 6).alias("hpa"))


@register(f"WITH {_GRID} SELECT ix, iy, CAST(floor(least(1.0, greatest(0.0, v / 100)) * 127) AS INT) AS shade FROM grid")
def grid_g4_palette(spark, d):
    return _grid(spark, d).select("ix", "iy", F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") / 100)) * 127).cast("int").alias("shade"))


@register(f"WITH {TRACTS} SELECT CAST(floor(lon / 30) AS BIGINT) AS c, CAST(floor(lat / 30) AS BIGINT) AS r, count(*) AS paths FROM tracts GROUP BY 1, 2")
def grid_g5_path_cells(spark, d):
    r, c = geo.cell("lat", "lon", 30)
    return tracts(spark, d).groupBy(c.alias("c"), r.alias("r")).agg(F.count(F.lit(1)).alias("paths"))


@register("SELECT c_custkey AS k, round(degrees(asin(((c_custkey + 0.5) / n * 2 - 1) * sin(radians(88)))), 5) AS lat, round(fmod(c_custkey * 137.50776405003785 + 180, 360) - 180, 5) AS lon FROM customer, (SELECT count(*) AS n FROM customer) WHERE c_custkey < n")
def grid_g6_seeds(spark, d):
    c = t(spark, d, "customer")
    n = c.agg(F.count(F.lit(1)).alias("n"))
    lat, lon = geo.seeds(F.col("c_custkey"), F.col("n"))
    return c.crossJoin(F.broadcast(n)).where("c_custkey < n").select(F.col("c_custkey").alias("k"), F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))
