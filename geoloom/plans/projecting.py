"""Registered projections and admission rules on records of the feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geo, records, text
from geoloom.operators import layers
from geoloom.plans.base import FEED, TRACTS, feed, t, tracts
from geoloom.plans.registry import register
from geoloom.plans.scans import _FIRE, fires


def _of(table: tuple, k: str) -> str:
    """SQL of either engine for the element of a list by a key."""
    return f"CASE {k} % {len(table)} " + " ".join(f"WHEN {i} THEN '{v}'" if v is not None else f"WHEN {i} THEN NULL" for i, v in enumerate(table)) + " END"


@register("SELECT p_partkey, concat_ws(', ', CASE WHEN p_size > 25 THEN 'Large' END, CASE WHEN p_retailprice > 1200 THEN 'Dear' END, CASE WHEN p_partkey % 3 = 0 THEN 'Third' END) AS groups FROM part")
def project_p7_flag_list(spark, d):
    return t(spark, d, "part").select("p_partkey", records.flags({"Large": F.col("p_size") > 25, "Dear": F.col("p_retailprice") > 1200, "Third": F.col("p_partkey") % 3 == 0}).alias("groups"))


@register(f"WITH {TRACTS} SELECT geoid, concat(upper(substr(lower(place), 1, 1)), substr(lower(place), 2), ' has ', pop, ' people', CASE WHEN income IS NOT NULL THEN '.' ELSE '; no income.' END) AS summary FROM tracts")
def project_p8_sentence(spark, d):
    rest = F.when(F.col("income").isNotNull(), ".").otherwise("; no income.")
    return tracts(spark, d).select("geoid", F.concat(records.sentence("place"), F.lit(" has "), F.col("pop").cast("string"), F.lit(" people"), rest).alias("summary"))


_LEVELS = ("Adult Level II trauma center", "Pediatric Level I; adult level III", "Level 4 and Level 2", "pediatric level 2", "no level", None)


@register(f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 END AS level FROM part")
def project_p9_best_level(spark, d):
    return t(spark, d, "part").select("p_partkey", records.best_level(F.expr(_of(_LEVELS, "p_partkey"))).alias("level"))


@register(f"WITH {FEED} SELECT coalesce(CASE WHEN k % 7 <> 0 THEN 'v' || vehicle END, 'item-' || printf('%05d', seq)) AS id, CASE WHEN speed > 1 THEN speed END AS speed FROM feed")
def project_p10_safe_record(spark, d):
    raw = F.when(F.col("speed") > 1, F.col("speed")).when(F.col("k") % 2 == 0, float("nan")).otherwise(float("inf"))
    return feed(spark, d).select(records.or_item(F.when(F.col("k") % 7 != 0, F.concat(F.lit("v"), F.col("vehicle").cast("string"))), F.col("seq")).alias("id"), records.safe_number(raw).alias("speed"))


@register(f"WITH {_FIRE} SELECT seq, CASE confidence WHEN 'l' THEN 0.3 WHEN 'n' THEN 0.6 WHEN 'h' THEN 0.9 ELSE greatest(0.0, least(1.0, CAST(confidence AS DOUBLE) / 100)) END AS confidence FROM fires")
def project_p11_confidence(spark, d):
    return fires(spark, d).select("seq", records.confidence("confidence").alias("confidence"))


_SENSORS, _CRAFT = ("VIIRS 375 m", "modis c6", "Sentinel-3 SLSTR", None), ("N20", "noaa-21", "Suomi NPP", "Terra", "Aqua-long", None)


@register(f"WITH {FEED} SELECT seq, CASE k % 4 WHEN 0 THEN 'VIIRS' WHEN 1 THEN 'MODIS' WHEN 2 THEN 'SENTINEL-3 S' ELSE '' END AS sensor, CASE k % 6 WHEN 0 THEN 'N20' WHEN 1 THEN 'N21' WHEN 2 THEN 'SNPP' WHEN 3 THEN 'TERRA' WHEN 4 THEN 'AQUA-L' ELSE '' END AS satellite FROM feed")
def project_p12_short_names(spark, d):
    return feed(spark, d).select("seq", records.sensor(F.expr(_of(_SENSORS, "k"))).alias("sensor"), records.satellite(F.expr(_of(_CRAFT, "k"))).alias("satellite"))


@register(f"WITH {_FIRE} SELECT 'firms:' || printf('%.4f', floor(lat * 10000) / 10000) || ':' || printf('%.4f', floor(lon * 10000) / 10000) || ':' || acq_time || ':' || k % 2 AS key, count(*) AS n FROM fires GROUP BY 1")
def project_p13_detection_key(spark, d):
    return fires(spark, d).groupBy(records.detection_key("firms", "lat", "lon", "acq_time", F.col("k") % 2).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_TYPES = ("B744", " r44 ", "F16", "ZZZZ", "C172", "AT72", "GLF5", "B789", "Q9", "GLID", None)


@register(f"WITH {FEED} SELECT seq, CASE k % 11 WHEN 0 THEN 'quadjet' WHEN 1 THEN 'helicopter' WHEN 2 THEN 'fastjet' WHEN 3 THEN 'airliner' WHEN 4 THEN 'light' WHEN 5 THEN 'turboprop' WHEN 6 THEN 'bizjet' WHEN 7 THEN 'widebody' WHEN 8 THEN 'uav' WHEN 9 THEN 'glider' ELSE CASE k % 3 WHEN 0 THEN 'helicopter' WHEN 1 THEN 'light' ELSE 'airliner' END END AS class FROM feed")
def project_p14_aircraft_class(spark, d):
    return feed(spark, d).select("seq", records.aircraft_class(F.expr(_of(_TYPES, "k")), F.expr(_of(("a7", "A2", "C9"), "k"))).alias("class"))


@register("SELECT p_partkey, CASE WHEN c = 0 THEN '' WHEN c = 30 THEN 'FISHING' WHEN c IN (31, 32) THEN 'TOWING' WHEN c = 33 THEN 'DREDGER' WHEN c = 34 THEN 'DIVING' WHEN c = 35 THEN 'MILITARY' WHEN c = 36 THEN 'SAILING' WHEN c = 37 THEN 'PLEASURE' WHEN c = 50 THEN 'PILOT' WHEN c = 51 THEN 'SAR' WHEN c = 52 THEN 'TUG' WHEN c = 53 THEN 'PORT TENDER' WHEN c = 54 THEN 'ANTI-POLLUTION' WHEN c = 55 THEN 'LAW ENFORCE' WHEN c = 58 THEN 'MEDICAL' WHEN c > 99 THEN 'Cargo ' || c WHEN c // 10 = 4 THEN 'HIGH-SPEED' WHEN c // 10 = 6 THEN 'PASSENGER' WHEN c // 10 = 7 THEN 'CARGO' WHEN c // 10 = 8 THEN 'TANKER' ELSE 'OTHER' END AS family FROM (SELECT p_partkey, p_partkey * 7 % 110 AS c FROM part)")
def project_p15_type_family(spark, d):
    code = F.col("p_partkey") * 7 % 110
    return t(spark, d, "part").select("p_partkey", records.vessel_type(F.when(code > 99, F.concat(F.lit("Cargo "), code.cast("string"))).otherwise(code.cast("string"))).alias("family"))


@register("SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 'station' WHEN p_brand LIKE '%1' THEN 'weather' WHEN p_brand LIKE '%2' THEN 'navigation' ELSE 'other' END AS class FROM part")
def project_p16_class_override(spark, d):
    classes = {f"Brand#{n}": "weather" if n % 10 == 1 else "navigation" for n in range(1, 60) if n % 10 in (1, 2)}
    return t(spark, d, "part").select("p_partkey", records.satellite_class("p_brand", "p_partkey", classes, station=7).alias("class"))


@register(f"WITH {FEED} SELECT seq, CASE WHEN kind = 'signup' THEN 'helicopter' WHEN kind <> 'error' AND speed * 100 <= 3000 THEN 'low' END AS reason FROM feed")
def project_p17_low_flyer(spark, d):
    return feed(spark, d).select("seq", records.low_flyer(F.when(F.col("kind") == "signup", "helicopter").otherwise("light"), F.col("kind") == "error", F.col("speed") * 100).alias("reason"))


@register("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Military airfield' WHEN 1 THEN 'Naval base' WHEN 2 THEN 'Firing range' WHEN 3 THEN 'Military land' WHEN 4 THEN 'Military land' ELSE 'Mapped installation' END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'Danger area' ELSE 'Mapped installation' END AS other FROM part")
def project_p18_installation(spark, d):
    kind = records.installation_class(F.expr(_of(("airfield", "NAVAL_BASE", "range", "barracks", None, "bunker"), "p_partkey")), F.expr(_of(("x", None, "x", "x", "military", None), "p_partkey")))
    return t(spark, d, "part").select("p_partkey", records.installation_label(kind).alias("label"), records.installation_label(F.when(F.col("p_partkey") % 2 == 0, "danger_area")).alias("other"))


@register(f"WITH {FEED} SELECT seq, CASE WHEN k = 0 THEN 'CLEAR' WHEN k BETWEEN 1 AND 2 THEN 'PARTLY CLOUDY' WHEN k = 3 THEN 'OVERCAST' WHEN k IN (45, 48) THEN 'FOG' WHEN k BETWEEN 51 AND 57 THEN 'DRIZZLE' WHEN k BETWEEN 61 AND 67 THEN 'RAIN' WHEN k BETWEEN 71 AND 77 THEN 'SNOW' WHEN k BETWEEN 80 AND 82 THEN 'RAIN SHOWERS' WHEN k BETWEEN 85 AND 86 THEN 'SNOW SHOWERS' WHEN k = 90 THEN 'CONDITIONS UNKNOWN' WHEN k >= 95 THEN 'THUNDERSTORM' ELSE 'MIXED CONDITIONS' END AS label FROM feed")
def project_p19_weather_label(spark, d):
    return feed(spark, d).select("seq", records.weather_label(F.when(F.col("k") != 90, F.col("k"))).alias("label"))


@register(f"WITH {FEED} SELECT seq, CASE WHEN k % 4 > 0 THEN CAST(k AS DOUBLE) END AS temperature, CASE WHEN k % 3 > 0 THEN strftime(make_timestamp(ms // 60000 * 60000000), '%Y-%m-%dT%H:%M') || 'Z' END AS at FROM feed")
def project_p20_weather_record(spark, d):
    raw = feed(spark, d).select("seq", F.when(F.col("k") % 4 > 0, F.col("k").cast("string")).otherwise("n/a").alias("t"), F.when(F.col("k") % 3 > 0, F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm")).otherwise("soon").alias("at"))
    return raw.select("seq", records.safe_number(F.col("t").try_cast("double")).alias("temperature"), records.utc_minute("at").alias("at"))


@register(f"WITH {TRACTS} SELECT geoid, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN place ELSE name || ', ' || place END AS label FROM tracts")
def project_p21_place_label(spark, d):
    locality = F.when(F.col("k") % 4 == 1, F.col("place")).when(F.col("k") % 4 > 1, F.col("name"))
    return tracts(spark, d).select("geoid", records.place_label(locality, F.when(F.col("k") % 4 > 0, F.col("place")).otherwise(" ")).alias("label"))


@register(f"WITH {FEED} SELECT seq, CASE WHEN speed * 5 < 70 THEN 'shallow' WHEN speed * 5 < 300 THEN 'intermediate' ELSE 'deep' END AS band FROM feed")
def project_p22_depth_band(spark, d):
    return feed(spark, d).select("seq", records.depth_band(F.col("speed") * 5).alias("band"))


_STATE = "CASE kind WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'unavailable' ELSE 'degraded' END WHEN 'click' THEN 'stale' WHEN 'view' THEN 'partial' WHEN 'signup' THEN 'fallback' ELSE 'nominal' END"


@register(f"WITH {FEED}, s AS (SELECT vehicle, {_STATE} AS state FROM feed) SELECT vehicle, min_by(state, list_position(['unavailable', 'loading', 'degraded', 'stale', 'fallback', 'partial', 'nominal', 'off'], state)) AS state FROM s GROUP BY vehicle")
def project_p23_feed_state(spark, d):
    kind = F.col("kind")
    state = records.feed_state(F.when(kind == "signup", "Fallback").otherwise("ok"), error=F.when(kind == "error", "timeout"), stale=kind == "click", partial=kind == "view", count=F.col("k") % 2)
    return feed(spark, d).select("vehicle", state.alias("state")).groupBy("vehicle").agg(records.worst_state("state").alias("state"))


@register("WITH p AS (SELECT o_orderkey, ((o_custkey % 25) || ':' || CAST(o_orderkey % 50 AS VARCHAR) || '.5,' || (o_custkey % 7) || ':1.5') AS code FROM orders) SELECT o_orderkey, n_name AS name, count(*) AS entries FROM (SELECT o_orderkey, CAST(split_part(unnest(string_split(code, ',')), ':', 1) AS INTEGER) AS idx FROM p) JOIN nation ON idx = n_nationkey GROUP BY 1, 2")
def project_p24_code_list(spark, d):
    code = F.concat((F.col("o_custkey") % 25).cast("string"), F.lit(":"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".5,"), (F.col("o_custkey") % 7).cast("string"), F.lit(":1.5"))
    listed = t(spark, d, "orders").select("o_orderkey", F.inline(text.index_list(code)))
    return listed.join(t(spark, d, "nation"), F.col("idx") == F.col("n_nationkey")).groupBy("o_orderkey", F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("entries"))


@register("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '—' WHEN o_orderstatus = 'O' THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) ELSE printf('%.1f', CAST(floor(o_totalprice) AS DOUBLE)) || '%' END AS shown FROM orders")
def project_p25_formats(spark, d):
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").select("o_orderkey", records.shown(F.when(s != "P", F.floor("o_totalprice")), F.when(s == "O", "count").otherwise("percent")).alias("shown"))


@register("SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL') THEN 'rail' WHEN regexp_matches(p_type, 'COPPER') THEN 'tram' WHEN regexp_matches(p_type, 'TIN') THEN 'ferry' WHEN p_size > 10 THEN 'bus' ELSE 'unknown' END AS mode FROM part")
def project_p26_mode(spark, d):
    return t(spark, d, "part").select("p_partkey", records.transit_mode("p_type", F.when(F.col("p_size") > 10, "bus")).alias("mode"))


@register("SELECT s_suppkey AS camera, greatest(5.0, least(120.0, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal / 50 END, 60.0))) AS fov, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_name END, n_name) AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def project_p27_defaults(spark, d):
    s, n = t(spark, d, "supplier"), t(spark, d, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    return j.select(F.col("s_suppkey").alias("camera"), records.clamped(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") / 50), 5.0, 120.0, 60.0).alias("fov"), F.coalesce(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")), "n_name").alias("label"))


@register("SELECT printf('%05d', c_custkey % 90000) AS cfips, round(c_acctbal / 10000, 4) AS broadband FROM customer WHERE c_custkey % 13 > 0")
def project_p29_workbook_rows(spark, d):
    raw = t(spark, d, "customer").select((F.col("c_custkey") % 90000).cast("string").alias("f"), F.when(F.col("c_custkey") % 13 > 0, (F.col("c_acctbal") / 10000).cast("string")).otherwise("-").alias("b"))
    return raw.select(records.padded("f", 5).alias("cfips"), F.round(records.safe_number(F.col("b").try_cast("double")), 4).alias("broadband")).where("cfips is not null and broadband is not null")


@register("SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN concat_ws('/', regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g'), CAST(c_custkey AS VARCHAR)) END AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def project_p30_path_index(spark, d):
    j = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("c_custkey", records.path_index(F.col("n_name"), F.when(F.col("c_custkey") % 4 > 0, F.col("r_name")), F.col("c_custkey").cast("string")).alias("path"))


@register("SELECT p_partkey, regexp_extract(p_type, '^([A-Z]+)', 1) AS name FROM part")
def project_p31_first_name(spark, d):
    joined = F.expr(_of((" & ", ", ", " and ", "/"), "p_partkey"))
    return t(spark, d, "part").select("p_partkey", records.first_name(F.concat(F.element_at(F.split("p_type", " "), 1), joined, F.lit("others"))).alias("name"))


@register("SELECT o_orderkey, (o_totalprice > 100000)::INT + (o_orderpriority LIKE '1%')::INT + least(CAST(o_custkey % 9 AS INT), 3) AS score FROM orders")
def project_p32_completeness(spark, d):
    return t(spark, d, "orders").select("o_orderkey", records.completeness([F.col("o_totalprice") > 100000, F.col("o_orderpriority").startswith("1")], [(F.col("o_custkey") % 9).cast("int")]).alias("score"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_discount * 8 >= 0.85 THEN 'free' WHEN 1 - l_discount * 8 >= 0.55 THEN 'slow' ELSE 'jam' END AS flow FROM lineitem")
def project_p33_congestion(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", records.congestion(1 - F.col("l_discount") * 8).alias("flow"))


@register(f"WITH {TRACTS} SELECT geoid, CASE WHEN k % 5 <> 0 THEN round(minority * 100000.0 / pop, 3) END AS rate FROM tracts")
def project_p34_rate(spark, d):
    return tracts(spark, d).select("geoid", records.rate(F.when(F.col("k") % 5 != 0, F.col("minority")), "pop").alias("rate"))


@register(f"WITH {FEED}, m AS (SELECT max(ms) - 43200000 AS now FROM feed) SELECT seq, ms FROM feed, m WHERE ms BETWEEN now - 86400000 AND now + 7200000")
def filter_f7_trailing_day(spark, d):
    f = feed(spark, d)
    now = f.agg((F.max("ms") - 43_200_000).alias("now"))
    return f.crossJoin(F.broadcast(now)).where(records.trailing("ms", "now")).select("seq", "ms")


_PARKS = ("national-park", "city-park", "state-park", "tribal-park", "garden")


@register("SELECT p_partkey FROM part WHERE p_partkey % 5 IN (0, 2, 3) AND greatest(p_size * 30.0, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END, 0)) >= 1000")
def filter_f8_large_parks(spark, d):
    return t(spark, d, "part").where(records.large_park(F.expr(_of(_PARKS, "p_partkey")), F.col("p_size") * 30.0, F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")))).select("p_partkey")


@register("SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 2) AND p_size % 5 <> 0 AND p_partkey % 3 <> 1 AND p_partkey % 7 <> 0")
def filter_f13_drivable(spark, d):
    kind, access = F.expr(_of(("motorway", "path", "minor", None), "p_partkey")), F.expr(_of((None, "private", "yes"), "p_partkey"))
    return t(spark, d, "part").where(records.drivable(kind, F.lit(None).cast("string"), F.when(F.col("p_size") % 5 == 0, "driveway"), access, F.when(F.col("p_partkey") % 7 == 0, "tunnel").otherwise("bridge"), F.lit(False))).select("p_partkey")


_TAGS = ("Top_40, pop-rock,POP  rock", "News,Talk", "ambient", "marine  weather", "public-safety", "hörspiel", None)


@register("SELECT p_partkey, p_partkey % 7 IN (0, 2) AS music, p_partkey % 7 = 1 AS news, p_partkey % 7 = 3 AS marine, p_partkey % 7 IN (5, 6) AS other, p_partkey % 7 = 0 AS rock FROM part")
def filter_f14_category(spark, d):
    tags = records.radio_tags(F.expr(_of(_TAGS, "p_partkey")))
    tagged = t(spark, d, "part").select("p_partkey", tags.alias("tags"))
    return tagged.select("p_partkey", *(records.radio_category("tags", c).alias(n) for n, c in (("music", "music"), ("news", "news"), ("marine", "aviation-marine"), ("other", "other"), ("rock", "genre:rock"))))


@register("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'top 40|pop rock' WHEN 1 THEN 'news|talk' WHEN 2 THEN 'ambient' WHEN 3 THEN 'marine weather' WHEN 4 THEN 'public safety' WHEN 5 THEN 'hörspiel' ELSE '' END AS tags FROM part")
def scalar_s4_radio_tags(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(records.radio_tags(F.expr(_of(_TAGS, "p_partkey"))), "|").alias("tags"))


@register("SELECT p_partkey FROM part WHERE lower(p_name || ' ' || p_brand || ' ' || p_type) LIKE '%brand#1%'")
def filter_f15_free_text(spark, d):
    return t(spark, d, "part").where(records.contains_any("Brand#1", "p_name", "p_brand", "p_type")).select("p_partkey")


_QUERIES = ("node(around:500,48.1,11.5)[amenity];out;", "way[highway];out;", "(node(1,2,3,4);way(1,2,3,4););out;", "node(around:5e7,1,2);out;", "way(0,0,40,40);out;", 'node["x"="(1,2,3,4)"];out;', "foreach(node(1,2,3,4););", "area(3600062422);out;", "// node(1,2,3,4)\nrel[name];", " ")


@register("SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN 'unbounded selector' WHEN 3 THEN 'radius too large' WHEN 4 THEN 'box too large' WHEN 5 THEN 'unbounded selector' WHEN 6 THEN 'unsupported construct' WHEN 8 THEN 'unbounded selector' WHEN 9 THEN 'no query' END AS refused FROM part")
def filter_f20_bounded_query(spark, d):
    return t(spark, d, "part").select("p_partkey", records.bounded_query(F.expr(_of(_QUERIES, "p_partkey"))).alias("refused"))


@register("SELECT doc_id FROM documents WHERE strlen(text) BETWEEN 1 AND 256 AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f/\\\\]')")
def filter_f21_identifier(spark, d):
    return t(spark, d, "documents").where(records.identifier("text")).select("doc_id")


@register("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' OR contains(lower(p_type), 'brass') OR contains(lower(p_name), 'brass')")
def filter_f22_class_filter(spark, d):
    return t(spark, d, "part").where((F.col("p_brand") == "Brand#12") | records.contains_any("brass", "p_type", "p_name")).select("p_partkey")


@register("SELECT o_orderkey, o_orderkey % 4 IN (0, 3) AS failed FROM orders")
def filter_f24_status(spark, d):
    return t(spark, d, "orders").select("o_orderkey", records.failed_status(F.expr(_of(("Launch Failure", "Success", None, "partial failure"), "o_orderkey"))).alias("failed"))


@register("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CASE WHEN l_linenumber % 2 = 1 THEN l_shipdate >= o_orderdate + INTERVAL 60 DAY - INTERVAL 60 DAY WHEN l_linenumber % 4 = 2 THEN TIMESTAMP '1998-01-01' - l_shipdate <= INTERVAL 180 DAY ELSE false END")
def filter_f25_current(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    n = F.col("l_linenumber")
    made, changed = F.when(n % 2 == 1, ms(F.col("l_shipdate"))), F.when(n % 4 == 2, ms(F.col("l_shipdate")))
    return j.where(records.current_publication(made, changed, ms(F.col("o_orderdate")) + 60 * records.DAY_MS, ms(F.lit("1998-01-01")))).select("l_orderkey", "l_linenumber")


@register(f"WITH {TRACTS}, b AS (SELECT county, k % 9 AS part, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM tracts GROUP BY 1, 2) SELECT county, part, w <= 0 AND e >= -40 AND s <= 20 AND n >= 5 AS touches, w >= -40 AND e <= 0 AND s >= 5 AND n <= 20 AS inside FROM b")
def filter_f3_boxes(spark, d):
    b = layers.index(tracts(spark, d).withColumn("chunk", F.struct("county", (F.col("k") % 9).alias("part"))), "chunk")
    view = (F.lit(-40), F.lit(5), F.lit(0), F.lit(20))
    box = ("west", "south", "east", "north")
    return b.select("chunk.county", "chunk.part", geo.boxes_overlap(box, view).alias("touches"), geo.box_inside(box, view).alias("inside"))


@register(f"WITH {FEED} SELECT seq, CASE WHEN k % 3 = 0 THEN greatest(1000, k * 100) ELSE least(300000, 30000 * CAST(power(2, least(k, 4)) AS BIGINT)) END AS wait_ms, CASE WHEN k * 1000 <= 20000 THEN 'fresh' WHEN k % 2 = 0 AND k * 1000 <= 60000 THEN 'stale' ELSE 'none' END AS served FROM feed")
def stream_st11_backoff(spark, d):
    f = feed(spark, d)
    served = records.served(F.col("ms") - F.col("k") * 1000, F.when(F.col("k") % 2 == 0, F.col("ms")), F.col("ms"), 20_000, 60_000)
    return f.select("seq", records.retry_delay(F.when(F.col("k") % 3 == 0, F.col("k") / 10), F.col("k")).cast("long").alias("wait_ms"), served.alias("served"))


@register(f"WITH {FEED} SELECT seq, CAST((ms - 21600000) // 3600000 % 24 // 6 * 6 AS INTEGER) AS cycle, CASE WHEN k % 4 IN (1, 3) THEN least(CAST(CASE WHEN k * 4.0 <= 144 THEN floor(k * 4.0 / 3 + 0.5) * 3 ELSE floor(k * 4.0 / 6 + 0.5) * 6 END AS INTEGER), 144) ELSE least(CAST(CASE WHEN k * 4.0 <= 144 THEN floor(k * 4.0 / 3 + 0.5) * 3 ELSE floor(k * 4.0 / 6 + 0.5) * 6 END AS INTEGER), 360) END AS step FROM feed")
def scalar_d12_forecast_step(spark, d):
    return feed(spark, d).select("seq", records.cycle_hour("ms").alias("cycle"), records.nearest_step(F.col("k") * 4.0, (F.col("k") % 4) * 6).alias("step"))


@register(f"WITH {FEED} SELECT seq, round(CASE WHEN k > 50 THEN 1 + (log10(least(greatest(speed, 0.5), 80.0)) - log10(0.5)) / (log10(80.0) - log10(0.5)) * 9 ELSE 1 END, 6) AS size FROM feed")
def geo_x6_log_scale(spark, d):
    return feed(spark, d).select("seq", F.round(records.log_scale(F.when(F.col("k") > 50, F.col("speed")).otherwise(0.0), 0.5, 80.0, 1.0, 10.0), 6).alias("size"))


@register(f"WITH {FEED} SELECT seq, round(lat - 1, 6) AS south, round(lat + 1, 6) AS north, round((lon - 1 + 180 + 360) % 360 - 180, 6) AS west, round((lon + 1 + 180 + 360) % 360 - 180, 6) AS east FROM feed")
def geo_x12_clamped_box(spark, d):
    w, s, e, n = records.clamp_box(F.col("lon") - 3, F.col("lat") - 5, F.col("lon") + 3, F.col("lat") + 5, "lat", "lon", 2.0)
    return feed(spark, d).select("seq", *(F.round(x, 6).alias(c) for c, x in (("south", s), ("north", n), ("west", w), ("east", e))))


@register(f"WITH {FEED} SELECT seq, round(k * 3 + ((lon - k * 3 + 540 + 720) % 360 - 180) * 0.31415926535, 6) AS heading FROM feed")
def geo_x19_lerp_angle(spark, d):
    return feed(spark, d).select("seq", F.round(records.lerp_angle(F.col("k") * 3, "lon", F.lit(0.31415926535)), 6).alias("heading"))


@register("SELECT o_orderkey, round(-o_totalprice * 0.6, 4) AS b1, round(-o_totalprice * 0.2, 4) AS b2, round(o_totalprice * 0.2, 4) AS b3, round(o_totalprice * 0.6, 4) AS b4 FROM orders")
def geo_x20_symmetric_breaks(spark, d):
    b = records.symmetric_breaks("o_totalprice")
    return t(spark, d, "orders").select("o_orderkey", *(F.round(b[i], 4).alias(f"b{i + 1}") for i in range(4)))


@register("WITH v AS (SELECT o_orderkey, o_totalprice AS v, pow(10, floor(log10(o_totalprice / 5) + 1e-12)) AS p FROM orders), s AS (SELECT *, p * CASE WHEN v / 5 / p <= 1 + 1e-9 THEN 1 WHEN v / 5 / p <= 2 + 1e-9 THEN 2 WHEN v / 5 / p <= 5 + 1e-9 THEN 5 ELSE 10 END AS step FROM v) SELECT o_orderkey, round(ceil(v / step - 1e-9) * step, 4) AS top, round(step, 4) AS step FROM s")
def geo_x21_nice_scale(spark, d):
    top, step = records.nice_scale("o_totalprice")
    return t(spark, d, "orders").select("o_orderkey", F.round(top, 4).alias("top"), F.round(step, 4).alias("step"))


@register(f"WITH {TRACTS} SELECT geoid, round(lon, 2) AS x, round(lat, 2) AS y, round(lon + 1, 2) AS x2 FROM tracts")
def array_a1_rounding(spark, d):
    ring = F.array(F.array(F.array(F.col("lon"), F.col("lat")), F.array(F.col("lon") + 1, F.col("lat"))))
    r = tracts(spark, d).select("geoid", geo.rounded(ring, 3, 2).alias("r"))
    return r.select("geoid", F.col("r")[0][0][0].alias("x"), F.col("r")[0][0][1].alias("y"), F.col("r")[0][1][0].alias("x2"))


@register(f"WITH {TRACTS} SELECT geoid, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS type, CASE WHEN k % 3 > 0 THEN k % 3 END AS polygons FROM tracts")
def array_a9_collapse(spark, d):
    p = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    square, line = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 0)), F.array(p(0, 0), p(1, 0))
    k = F.col("k") % 3
    polygons = F.when(k == 0, F.array(F.array(line))).when(k == 1, F.array(F.array(square, line), F.array(line))).otherwise(F.array(F.array(square), F.array(square)))
    c = geo.collapsed(polygons)
    return tracts(spark, d).select("geoid", c["type"].alias("type"), F.when(c.isNotNull(), F.size(c["polygons"])).cast("long").alias("polygons"))


@register("SELECT o_orderkey, CAST(avg(l_partkey) AS DOUBLE) AS x, CAST(avg(l_quantity) AS DOUBLE) AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def array_a10_mean_vertex(spark, d):
    points = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))).alias("p"))
    x, y = geo.mean_vertex("p")
    return points.select(F.col("l_orderkey").alias("o_orderkey"), x.alias("x"), y.alias("y"))
