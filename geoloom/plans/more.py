"""Registered queries on classes, hulls, routes and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import shapes
from geoloom.operators import joins, routes
from geoloom.plans.base import FEED, TRACTS, feed, t, tracts
from geoloom.plans.registry import register

@register(f"WITH {TRACTS} SELECT county, count(*) AS n, min(lon) AS west, max(lat) AS north FROM tracts GROUP BY county")
def agg_a11_hulls(spark, d):
    h = shapes.hulls(tracts(spark, d), ["county"], "lon", "lat")
    return h.select("county", "n", F.array_min(F.transform("ring", lambda p: p["x"])).alias("west"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("north"))


@register()
def filter_f17_plausible_route(spark, d):
    f = feed(spark, d)
    ends = (F.lit(40.0), F.lit(-74.0), F.lit(51.0), F.lit(0.0))
    return f.select("seq", routes.plausible("lat", "lon", F.col("speed") / 10, *ends).alias("plausible"))


@register(f"WITH {FEED}, p AS (SELECT DISTINCT CAST(ms // 3600000 * 3600000 AS BIGINT) AS at FROM feed WHERE kind = 'view'), q AS (SELECT DISTINCT CAST(ms // 1800000 * 1800000 AS BIGINT) AS ms FROM feed) SELECT q.ms, CASE WHEN q.ms - p.at <= 10800000 THEN p.at END AS at FROM q ASOF LEFT JOIN p ON q.ms >= p.at")
def stream_st14_timeline(spark, d):
    f = feed(spark, d)
    product = f.where("kind = 'view'").select(F.lit(1).alias("one"), (F.floor(F.col("ms") / 3600000) * 3600000).alias("ms")).distinct()
    asked = f.select(F.lit(1).alias("one"), (F.floor(F.col("ms") / 1800000) * 1800000).alias("ms")).distinct()
    return joins.asof(asked, product, ["one"], "ms", [], F.lit(10800000)).select("ms", "at")


