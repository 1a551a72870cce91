"""Registered scans and projections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import text
from geoloom.operators import layers
from geoloom.plans.base import FEED, TRACTS, feed, shared, t, tracts
from geoloom.plans.registry import register


def _lines(spark, d) -> DataFrame:
    """Tracts as feature lines of a chunked layer."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("geoid").alias("id"), F.struct("geoid", "name", "pop", "income").alias("properties"), geometry.alias("geometry"))
    return tracts(spark, d).select(F.col("county").alias("chunk"), F.to_json(feature).alias("value"))


@register(f"WITH {TRACTS} SELECT geoid AS id, county AS chunk, name, pop, income, lon, lat FROM tracts")
def scan_s1_feature_lines(spark: SparkSession, d: str) -> DataFrame:
    schema = "type string, id string, properties struct<geoid:string,name:string,pop:long,income:double>, geometry struct<type:string,coordinates:array<double>>"
    f = layers.features(_lines(spark, d), schema)
    return f.select("id", "chunk", "properties.name", "properties.pop", "properties.income", F.element_at("geometry.coordinates", 1).alias("lon"), F.element_at("geometry.coordinates", 2).alias("lat"))


@register(f"WITH {TRACTS} SELECT geoid, county, pop, lon, lat FROM tracts WHERE state = '01' AND lon BETWEEN -90 AND 60 AND lat BETWEEN -45 AND 50")
def scan_s2_layer_pruned(spark, d):
    return layers.pruned(tracts(spark, d), state="01", view=(-90, -45, 60, 50)).select("geoid", "county", "pop", "lon", "lat")


@register(f"WITH {TRACTS} SELECT geoid, pop, lon, lat FROM tracts WHERE (lon >= 150 OR lon <= -120) AND lat BETWEEN -30 AND 60")
def scan_s2_clustered_view(spark, d):
    """The tracts written along a curve, and a view over the date line read from the files that meet it."""
    path = f"{shared(spark)}/layers/{uuid.uuid4().hex}"
    layers.write_clustered(tracts(spark, d).select("geoid", "pop", "lon", "lat"), path, 16)
    return layers.read_view(spark, path, 150.0, -30.0, -120.0, 60.0)


@register(f"WITH {TRACTS} SELECT county AS chunk, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(*) AS areas FROM tracts GROUP BY county")
def scan_s2_layer_index(spark, d):
    return layers.index(tracts(spark, d), "county")


@register(f"WITH {TRACTS}, c AS (SELECT DISTINCT county FROM tracts ORDER BY county LIMIT 3), r AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY geoid) AS rn FROM tracts WHERE county IN (SELECT county FROM c)) SELECT geoid, pop, income FROM r WHERE rn <= 400")
def scan_s5_layer_sample(spark, d):
    return layers.sample(tracts(spark, d), "county", "geoid").select("geoid", "pop", "income")


_FIRE = f"""{FEED}, fires AS (SELECT seq, lat, lon, CASE WHEN k % 2 = 0 THEN speed END AS bright_ti4, CASE WHEN k % 2 = 1 THEN speed + 1 END AS brightness, speed AS frp,
  CAST(seq * 7 % 24 * 100 + seq * 13 % 60 AS INTEGER) AS acq_time, CASE WHEN k % 3 = 0 THEN 'l' WHEN k % 3 = 1 THEN 'n' ELSE CAST(k AS VARCHAR) END AS confidence, k, ms FROM feed)"""


def fires(spark, d) -> DataFrame:
    """Position reports as fire detections in the two formats of their sensors."""
    return feed(spark, d).select(
        "seq", "lat", "lon", F.expr("case when k % 2 = 0 then speed end").alias("bright_ti4"), F.expr("case when k % 2 = 1 then speed + 1 end").alias("brightness"), F.col("speed").alias("frp"),
        F.expr("cast(seq * 7 % 24 * 100 + seq * 13 % 60 as int)").alias("acq_time"), F.expr("case when k % 3 = 0 then 'l' when k % 3 = 1 then 'n' else cast(k as string) end").alias("confidence"), "k", "ms",
    )


@register("SELECT p_partkey, p_type LIKE '%BRASS%' OR p_size % 2 = 0 AS is_camera FROM part")
def scan_s28_multi_value_tag(spark, d):
    tag = F.concat_ws("; ", F.when(F.col("p_type").contains("BRASS"), "alpr").otherwise("dome"), F.when(F.col("p_size") % 2 == 0, " ALPR ").otherwise("ptz"))
    return t(spark, d, "part").select("p_partkey", text.tokens_match(tag, "ALPR").alias("is_camera"))


@register("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages WHERE regexp_matches(html, '<title>')")
def scan_s30_page_titles(spark, d):
    return t(spark, d, "pages").where(F.col("html").contains("<title>")).select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


@register("WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href FROM pages) SELECT href, count(*) AS n FROM x GROUP BY href")
def scan_s30_page_links(spark, d):
    return t(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1)).alias("href")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-06-01' AND l_quantity < 10")
def scan_s36_predicate(spark, d):
    return t(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1997-06-01' and l_quantity < 10").select("l_orderkey", "l_linenumber", "l_extendedprice")


@register(f"WITH {TRACTS} SELECT geoid, round(lon, 5) AS lon, round(lat, 5) AS lat, income AS household_income, pop FROM tracts")
def project_p3_rows(spark, d):
    return layers.rows(tracts(spark, d), {"income": "household_income"}, ["geoid", "lon", "lat", "income", "pop"])


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN round(100 * (l_quantity - 5) / l_quantity, 2) END AS share FROM lineitem")
def project_p5_share(spark, d):
    part = F.col("l_quantity") - 5
    whole = F.when(F.col("l_quantity") > 10, F.col("l_quantity"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", layers.share(part, whole).alias("share"))


@register(f"WITH {TRACTS} SELECT geoid, round(100.0 * minority / pop, 2) AS minority_share, round(100.0 * white / pop, 2) AS white_share, round(100.0 * (minority + white) / pop, 2) AS both_share FROM tracts")
def project_p6_declared_measures(spark, d):
    return layers.measured(tracts(spark, d), {"minority_share": (["minority"], ["pop"]), "white_share": (["white"], ["pop"]), "both_share": (["minority", "white"], ["pop"])}).select("geoid", "minority_share", "white_share", "both_share")


