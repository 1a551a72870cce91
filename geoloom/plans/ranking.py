"""Registered windows, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import aggregates, joins, layers, routes
from geoloom.plans import report
from geoloom.plans.base import FEED, TRACTS, feed, t, tracts
from geoloom.plans.joining import _SITES, sites
from geoloom.plans.registry import register
from geoloom.plans.scans import _FIRE, fires


@register("""WITH a AS (SELECT c_custkey AS geoid, c_name AS name, n_name AS state, sum(o_totalprice) AS spent FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3)
SELECT row_number() OVER (ORDER BY spent DESC, geoid) AS rank, geoid, name, state, round(spent, 2) AS spent, (SELECT count(*) FROM a WHERE spent IS NOT NULL) AS eligible FROM a WHERE spent IS NOT NULL ORDER BY spent DESC, geoid LIMIT 50""")
def report_t1_top_areas(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    spent = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    areas = c.join(n, c.c_nationkey == n.n_nationkey).join(spent, "c_custkey", "left").select(F.col("c_custkey").alias("geoid"), F.col("c_name").alias("name"), F.col("n_name").alias("state"), "spent")
    plan = report.planned({"rank_by": "spent", "columns": ["geoid", "name", "state", "spent"]}, areas.columns)
    return report.ranked(areas, plan).select("rank", "geoid", "name", "state", F.round("spent", 2).alias("spent"), "eligible")


@register(f"WITH {TRACTS}, c AS (SELECT county, round(avg(income), 6) AS m, count(*) AS n FROM tracts GROUP BY county) SELECT county, CASE WHEN m IS NOT NULL THEN rank() OVER (ORDER BY m DESC NULLS LAST) END AS r, CASE WHEN m IS NOT NULL THEN count(m) OVER () END AS of_r FROM c")
def window_w1_rank_of(spark, d):
    c = tracts(spark, d).groupBy("county").agg(F.round(F.avg("income"), 6).alias("m"))
    return c.select("county", F.when(F.col("m").isNotNull(), F.rank().over(W.orderBy(F.col("m").desc_nulls_last()))).cast("long").alias("r"), F.when(F.col("m").isNotNull(), F.count("m").over(W.partitionBy())).alias("of_r"))


@register(f"WITH {TRACTS} SELECT geoid, row_number() OVER (PARTITION BY county ORDER BY income DESC, geoid) AS rank, count(*) OVER (PARTITION BY county) AS eligible FROM tracts WHERE income IS NOT NULL")
def window_w2_rank_in_county(spark, d):
    w = W.partitionBy("county")
    return tracts(spark, d).where("income is not null").select("geoid", F.row_number().over(w.orderBy(F.desc("income"), "geoid")).cast("long").alias("rank"), F.count(F.lit(1)).over(w).alias("eligible"))


@register(f"WITH {FEED} SELECT vehicle, min(seq) AS seq FROM feed GROUP BY vehicle")
def window_w3_keep_first(spark, d):
    """The smallest row of each key, combined before the shuffle."""
    return feed(spark, d).groupBy("vehicle").agg(F.min_by(F.struct("seq", "kind"), "seq").alias("r")).select("vehicle", "r.seq")


@register(f"WITH {FEED} SELECT seq, last_value(CASE WHEN kind = 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY seq ROWS UNBOUNDED PRECEDING) AS state FROM feed")
def window_w4_fill_down(spark, d):
    w = W.partitionBy("vehicle").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return feed(spark, d).select("seq", F.last(F.when(F.col("kind") == "signup", F.col("seq")), ignorenulls=True).over(w).alias("state"))


@register(f"WITH {FEED} SELECT seq, lead(ms) OVER (PARTITION BY vehicle ORDER BY ms, seq) AS until FROM feed")
def window_w5_lead(spark, d):
    return feed(spark, d).select("seq", F.lead("ms").over(W.partitionBy("vehicle").orderBy("ms", "seq")).alias("until"))


@register(f"WITH {FEED} SELECT seq, count(*) OVER (PARTITION BY vehicle ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS hits FROM feed")
def window_w6_trailing_hits(spark, d):
    return feed(spark, d).select("seq", F.count(F.lit(1)).over(W.partitionBy("vehicle").orderBy("ms").rangeBetween(-3600000, 0)).alias("hits"))


@register(f"WITH {FEED}, g AS (SELECT vehicle, CAST(floor(seq / 50) AS BIGINT) AS col, CAST(floor(max(k) / 34) AS BIGINT) AS band FROM feed GROUP BY 1, 2), i AS (SELECT *, col - row_number() OVER (PARTITION BY vehicle, band ORDER BY col) AS isl FROM g) SELECT vehicle, band, min(col) AS first, max(col) AS last FROM i GROUP BY vehicle, band, isl")
def window_w8_runs(spark, d):
    g = feed(spark, d).groupBy("vehicle", F.floor(F.col("seq") / 50).cast("long").alias("col")).agg(F.floor(F.max("k") / 34).cast("long").alias("band"))
    return aggregates.runs(g, ["vehicle"], "col", "band")


@register(f"WITH {FEED}, s AS (SELECT vehicle, seq, ms <= lag(ms) OVER (PARTITION BY vehicle ORDER BY seq) AS back FROM feed) SELECT seq FROM s WHERE back")
def window_w9_not_rising(spark, d):
    return feed(spark, d).select("seq", (F.col("ms") <= F.lag("ms").over(W.partitionBy("vehicle").orderBy("seq"))).alias("back")).where("back").select("seq")


@register("WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) SELECT p_partkey, turn FROM r ORDER BY turn, p_brand LIMIT 60")
def window_w10_fair_share(spark, d):
    return layers.fair_share(t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 60).select("p_partkey", "turn")


@register("SELECT l_orderkey AS shot, l_linenumber AS segment, round(sum(l_quantity) OVER w - l_quantity, 4) AS begins, round(sum(l_quantity) OVER w, 4) AS ends FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def window_w11_segment_times(spark, d):
    end = F.sum("l_quantity").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(W.unboundedPreceding, 0))
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("shot"), F.col("l_linenumber").alias("segment"), F.round(end - F.col("l_quantity"), 4).alias("begins"), F.round(end, 4).alias("ends"))


@register(f"WITH {TRACTS}, r AS (SELECT geoid, pop, row_number() OVER (PARTITION BY floor(lon / 11.25), floor(lat / 11.25) ORDER BY pop DESC, geoid) AS rn FROM tracts) SELECT geoid, pop FROM r WHERE rn = 1 ORDER BY pop DESC, geoid LIMIT 512")
def window_w12_grid_thinning(spark, d):
    r, c = geo.cell("lat", "lon", 11.25)
    best = tracts(spark, d).groupBy(r.alias("r"), c.alias("c")).agg(F.min(F.struct((-F.col("pop")).alias("n"), "geoid", "pop")).alias("b"))
    return best.select("b.geoid", "b.pop").orderBy(F.desc("pop"), "geoid").limit(512)


@register("WITH s AS (SELECT l_orderkey, row_number() OVER w AS line, sum(l_quantity) OVER w AS upto, l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)) SELECT l_orderkey, min(line) AS segment, round(min_by((40 - upto + l_quantity) / l_quantity, line), 8) AS fraction FROM s WHERE upto >= 40 GROUP BY l_orderkey")
def window_w13_along_line(spark, d):
    found = routes.along_line(t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", 40)
    return found.select("l_orderkey", "segment", F.round("fraction", 8).alias("fraction"))


@register(f"WITH {TRACTS} SELECT geoid, pop FROM tracts ORDER BY pop DESC, geoid LIMIT 96")
def top_t2_priority(spark, d):
    return tracts(spark, d).select("geoid", "pop").orderBy(F.desc("pop"), "geoid").limit(96)


@register(f"WITH {FEED} SELECT seq FROM feed ORDER BY (vehicle % 11 = 0) DESC, k DESC, (seq * 2654435761) % 4294967296, seq LIMIT 256")
def top_t3_cohort(spark, d):
    """Incumbents first, then priority, then a hash."""
    return feed(spark, d).orderBy((F.col("vehicle") % 11 == 0).desc(), F.desc("k"), (F.col("seq") * 2654435761) % 4294967296, "seq").limit(256).select("seq")


@register(f"WITH {_FIRE} SELECT seq, frp FROM fires ORDER BY frp DESC, seq LIMIT 2000")
def top_t4_strongest(spark, d):
    return fires(spark, d).select("seq", "frp").orderBy(F.desc("frp"), "seq").limit(2000)


@register("SELECT p_partkey FROM part ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_partkey LIMIT 300")
def top_t5_tiers(spark, d):
    return t(spark, d, "part").orderBy(F.when(F.col("p_size") > 25, 0).otherwise(1), "p_partkey").limit(300).select("p_partkey")


@register(f"WITH {TRACTS} SELECT geoid, round(2 * 6371 * asin(sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 20) / 2), 2))), 4) AS km FROM tracts ORDER BY (segment = 'BUILDING') DESC, km, geoid LIMIT 100")
def top_t6_near_tier(spark, d):
    km = F.round(geo.haversine(F.lit(10.0), F.lit(20.0), "lat", "lon"), 4)
    return tracts(spark, d).withColumn("km", km).orderBy((F.col("segment") == "BUILDING").desc(), "km", "geoid").limit(100).select("geoid", "km")


@register(f"WITH {_SITES} SELECT site FROM sites ORDER BY site % 3 = 0, site % 5, site LIMIT 40")
def top_t7_navigation(spark, d):
    return sites(spark, d).orderBy(F.col("site") % 3 == 0, F.col("site") % 5, "site").limit(40).select("site")


@register(f"WITH {TRACTS}, r AS (SELECT place, segment, max(pop) AS pop, min(geoid) AS geoid FROM tracts GROUP BY 1, 2) SELECT place, segment, geoid FROM r ORDER BY pop DESC, geoid LIMIT 20")
def top_t8_distinct_places(spark, d):
    r = tracts(spark, d).groupBy("place", "segment").agg(F.max("pop").alias("pop"), F.min("geoid").alias("geoid"))
    return r.orderBy(F.desc("pop"), "geoid").limit(20).select("place", "segment", "geoid")


@register("SELECT row_number() OVER (ORDER BY n_regionkey, n_name, n_nationkey) AS line, n_name FROM nation")
def sort_t9_three_keys(spark, d):
    return t(spark, d, "nation").select(F.row_number().over(W.orderBy("n_regionkey", "n_name", "n_nationkey")).cast("long").alias("line"), "n_name")


@register("SELECT p_partkey, row_number() OVER (PARTITION BY substr(p_brand, 1, 1) ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT), p_partkey) AS line FROM part")
def sort_t10_typed_ids(spark, d):
    letter, number = F.substring("p_brand", 1, 1), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    return t(spark, d, "part").select("p_partkey", F.row_number().over(W.partitionBy(letter).orderBy(number, "p_partkey")).cast("long").alias("line"))


@register(f"WITH {TRACTS}, x AS (SELECT geoid, CAST(floor((lon + 180) / 360 * 64) AS BIGINT) AS x, CAST(least(63, greatest(0, floor((1 - ln(tan(radians(least(greatest(lat, -85.05112878), 85.05112878))) + 1 / cos(radians(least(greatest(lat, -85.05112878), 85.05112878)))) / pi()) / 2 * 64))) AS BIGINT) AS y FROM tracts) SELECT x, y, count(*) AS n FROM x GROUP BY x, y ORDER BY abs(x - 32) + abs(y - 32), x, y LIMIT 50")
def top_t11_tiles_outward(spark, d):
    x, y = geo.tile_x("lon", 6), geo.tile_y("lat", 6)
    n = tracts(spark, d).groupBy(x.cast("long").alias("x"), y.cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.abs(F.col("x") - 32) + F.abs(F.col("y") - 32), "x", "y").limit(50)


@register("WITH v AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) - 1 AS i, count(*) OVER () AS n FROM lineitem WHERE l_quantity >= 5) SELECT p, v AS break FROM v, (VALUES (0.5), (0.75), (0.9), (0.97), (0.99)) b(p) WHERE i = floor(CAST(p AS DOUBLE) * n)")
def top_t12_index_breaks(spark, d):
    return aggregates.index_breaks(t(spark, d, "lineitem"), "l_quantity", [0.5, 0.75, 0.9, 0.97, 0.99], 5).select(F.col("p").cast("decimal(3,2)").alias("p"), "break")


@register("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 10")
def top_t13_groups(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(10)


@register(f"WITH {FEED}, {_SITES}, u AS (SELECT 'f' || seq AS id, lat, lon FROM feed UNION ALL SELECT 's' || site, lat, lon FROM sites) SELECT id FROM u WHERE id NOT IN ('s1', 's2', 'f3') ORDER BY pow(lat, 2) + pow(lon, 2), id LIMIT 1")
def top_t14_closest_unvisited(spark, d):
    u = feed(spark, d).select(F.concat(F.lit("f"), F.col("seq").cast("string")).alias("id"), "lat", "lon").unionByName(sites(spark, d).select(F.concat(F.lit("s"), F.col("site").cast("string")).alias("id"), "lat", "lon"))
    visited = spark.createDataFrame([("s1",), ("s2",), ("f3",)], "id string")
    return u.join(F.broadcast(visited), "id", "left_anti").orderBy(F.col("lat") * F.col("lat") + F.col("lon") * F.col("lon"), "id").limit(1).select("id")


@register("SELECT p_partkey FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE (rn - 1) % 5 = 2")
def sample_t15_stride(spark, d):
    rn = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    return t(spark, d, "part").withColumn("rn", rn).where((F.col("rn") - 1) % 5 == 2).select("p_partkey")


@register("SELECT o_orderkey FROM orders ORDER BY (o_orderstatus = 'F')::INT + (o_totalprice > 100000)::INT DESC, o_orderdate DESC, o_orderkey DESC LIMIT 80")
def top_t16_roster(spark, d):
    score = (F.col("o_orderstatus") == "F").cast("int") + (F.col("o_totalprice") > 100000).cast("int")
    return t(spark, d, "orders").orderBy(score.desc(), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(80).select("o_orderkey")


@register("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def set_u1_union_all(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@register(f"WITH {FEED} SELECT CAST(floor(ms / 3600000) AS BIGINT) AS hour FROM feed WHERE kind = 'view' UNION SELECT CAST(floor(ms / 3600000) AS BIGINT) FROM feed WHERE kind = 'click'")
def set_u2_union_distinct(spark, d):
    hour = F.floor(F.col("ms") / 3600000).cast("long").alias("hour")
    return feed(spark, d).where("kind = 'view'").select(hour).union(feed(spark, d).where("kind = 'click'").select(hour)).distinct()


@register("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3")
def set_u3_intersect(spark, d):
    c, s, n = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), t(spark, d, "supplier").select("s_nationkey"), t(spark, d, "nation").where("n_regionkey < 3").select("n_nationkey")
    return c.intersect(s).intersect(n)


@register("SELECT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_u4_except(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("part")).exceptAll(t(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey").distinct())


@register("SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def set_u5_keep_last(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_orderkey").alias("last"))


@register("SELECT id, min_by(tag, pri) AS tag FROM (SELECT l_partkey AS id, 'r' AS tag, 1 AS pri FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 'a', 2 FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT p_partkey, 'p', 3 FROM part) GROUP BY id")
def set_u7_priority_union(spark, d):
    lines = t(spark, d, "lineitem")
    of = lambda flag: lines.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("id"))
    return joins.priority_union([("r", of("R")), ("a", of("A")), ("p", t(spark, d, "part").select(F.col("p_partkey").alias("id")))], "id")
