"""Mapped features, installations, radio stations and imagery granules from their JSON answers as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo, records, text

_POINTS = "array<struct<lat:double,lon:double>>"
_ELEMENTS = f"elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,bounds:struct<minlat:double,minlon:double,maxlat:double,maxlon:double>,tags:map<string,string>,geometry:{_POINTS},members:array<struct<role:string,geometry:{_POINTS}>>>>"


def _elements(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.inline(F.from_json(value, _ELEMENTS)["elements"]))


def _finite(points: Column) -> Column:
    return F.filter(F.coalesce(points, F.from_json(F.lit("[]"), _POINTS)), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def stitched(ways: Column) -> Column:
    """Ways (arrays of points) chained into one line: each next one is the first left that begins or ends where it ends."""
    empty = F.slice(F.element_at(ways, 1), 1, 0)
    start = F.struct(F.element_at(ways, 1).alias("line"), F.slice(ways, 2, F.greatest(F.size(ways) - 1, F.lit(0))).alias("left"))

    def step(state, _):
        end = F.element_at(state["line"], -1)
        fits = F.transform(state["left"], lambda w: (F.element_at(w, 1) == end) | (F.element_at(w, -1) == end))
        k = F.array_position(fits, F.lit(True)).cast("int")
        way = F.element_at(state["left"], F.greatest(k, F.lit(1)))
        turned = F.when(F.element_at(way, 1) == end, way).otherwise(F.reverse(way))
        rest = F.concat(F.slice(state["left"], 1, F.greatest(k - 1, F.lit(0))), F.slice(state["left"], k + 1, F.size(state["left"])))
        return F.when(k > 0, F.struct(F.concat(state["line"], F.slice(turned, 2, F.size(turned))).alias("line"), rest.alias("left"))).otherwise(state)

    chained = F.aggregate(F.sequence(F.lit(1), F.size(ways)), start, step, lambda s: s["line"])
    return F.when(F.size(ways) > 0, chained).otherwise(F.coalesce(empty, F.from_json(F.lit("[]"), _POINTS)))


def features(df: DataFrame, value: str = "value") -> DataFrame:
    """Features of map answers (one in each row): id, type, names, level, building, height_m, coordinates, lat, lon.

    A relation's outer ways are chained into one ring; a point is the element's own place, else its centre.
    """
    e = _elements(df, value)
    outer = F.filter(F.transform(F.filter("members", lambda m: F.coalesce(m["role"], F.lit("")).isin("", "outer")), lambda m: _finite(m["geometry"])), lambda w: F.size(w) >= 2)
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    coordinates = F.when(F.col("geometry").isNotNull(), _finite(F.col("geometry"))).when(F.col("members").isNotNull(), stitched(outer)).otherwise(F.from_json(F.lit("[]"), _POINTS))
    return e.select(
        "id", "type", F.when(F.col("type") == "area", "administrative").otherwise("feature").alias("category"),
        tag("name").alias("name"), tag("name:en").alias("english"), tag("official_name").alias("official"), F.coalesce(F.nullif(tag("admin_level").try_cast("int"), F.lit(0)), F.lit(99)).alias("level"),
        F.coalesce(tag("building") != "", F.lit(False)).alias("building"), records.building_height("tags").alias("height_m"), coordinates.alias("coordinates"),
        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"),
    )


def installations(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(installations, the first of each id; one row with how many elements were dropped).

    An element needs a class by its tags and a place: its own, its centre, or the middle of bounds of at most 10 degrees.
    """
    e = _elements(df, value).withColumn("_n", F.monotonically_increasing_id())
    b = "bounds"
    south, west, north, east = (F.col(f"{b}.{x}") for x in ("minlat", "minlon", "maxlat", "maxlon"))
    fits = geo.valid_point(south, west) & geo.valid_point(north, east) & (south <= north) & (west <= east) & (north - south <= 10) & (east - west <= 10)
    lat = F.coalesce("lat", "center.lat", F.when(fits, (south + north) / 2))
    lon = F.coalesce("lon", "center.lon", F.when(fits, (west + east) / 2))
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    kind = records.installation_class(tag("military"), tag("landuse"))
    name = F.coalesce(F.nullif(F.trim(F.coalesce(tag("name"), tag("name:en"))), F.lit("")), records.installation_label(kind))
    ok = F.col("type").isin("node", "way", "relation") & F.col("id").isNotNull()
    rows = e.where(ok).select("_n", F.concat_ws(":", F.lit("osm"), "type", F.col("id").cast("string")).alias("id"), kind.alias("class"), name.alias("name"), lat.alias("lat"), lon.alias("lon"))
    rows = rows.where(F.col("class").isNotNull() & geo.valid_point("lat", "lon"))
    first = rows.groupBy("id").agg(F.min_by(F.struct("class", "name", "lat", "lon"), "_n").alias("r")).select("id", "r.*")
    dropped = e.agg(F.count(F.lit(1)).alias("n")).crossJoin(first.agg(F.count(F.lit(1)).alias("k"))).select((F.col("n") - F.col("k")).alias("dropped"))
    return first, dropped


_STATION = "stationuuid string, name string, url string, url_resolved string, homepage string, tags string, language string, state string, country string, countrycode string, codec string, bitrate int, lastcheckok int, hls int, geo_lat double, geo_long double, clickcount bigint"
#: What a station's identifier and codec look like, and the bounds of its bit rate and clicks.
_UUID, _CODEC = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"(?i)^(MP3|AAC(\+|-LC|-HE)?|HE-AAC)$"
BIT_RATES, MOST_CLICKS = (8, 1024), 10_000_000


def stations(df: DataFrame, value: str = "value") -> DataFrame:
    """Radio stations (one JSON object in each row) that may be shown: checked, placed, with a plain codec and a public https stream."""
    r = df.select(F.from_json(value, _STATION).alias("r")).select("r.*")
    url = F.coalesce(F.nullif(F.trim("url_resolved"), F.lit("")), F.trim("url"))
    safe = lambda u: F.when(F.lower(u).startswith("https://") & text.public_host(u), u)
    ok = F.lower("stationuuid").rlike(_UUID) & (F.col("lastcheckok") == 1) & (F.coalesce("hls", F.lit(0)) != 1) & geo.valid_point("geo_lat", "geo_long") & F.trim("codec").rlike(_CODEC)
    languages = F.slice(F.filter(F.transform(F.split(F.coalesce("language", F.lit("")), ","), lambda x: F.substring(F.trim(x), 1, 40)), lambda x: x != ""), 1, 8)
    return r.where(ok).select(
        F.lower("stationuuid").alias("id"), text.clean("name", 140).alias("name"), F.col("geo_lat").alias("lat"), F.col("geo_long").alias("lon"), safe(url).alias("stream"), safe(F.trim("homepage")).alias("homepage"),
        records.radio_tags("tags").alias("tags"), languages.alias("languages"), text.clean("state", 80).alias("state"), text.clean("country", 80).alias("country"), F.upper(F.substring(F.trim("countrycode"), 1, 2)).alias("country_code"),
        F.upper(F.trim("codec")).alias("codec"), F.when(F.col("bitrate").between(*BIT_RATES), F.col("bitrate")).alias("bitrate"), F.greatest(F.lit(0), F.least(F.lit(MOST_CLICKS), F.coalesce("clickcount", F.lit(0)))).cast("long").alias("clicks"),
    ).where("name is not null and stream is not null")


_CORNERS = "array<struct<Longitude:double,Latitude:double>>"
_GRANULES = f"hits bigint, items array<struct<meta:struct<`concept-id`:string,`native-id`:string>,umm:struct<GranuleUR:string,TemporalExtent:struct<RangeDateTime:struct<BeginningDateTime:string,EndingDateTime:string>>,AdditionalAttributes:array<struct<Name:string,Values:array<string>>>,SpatialExtent:struct<HorizontalSpatialDomain:struct<Geometry:struct<GPolygons:array<struct<Boundary:struct<Points:{_CORNERS}>>>,BoundingRectangles:array<struct<WestBoundingCoordinate:double,SouthBoundingCoordinate:double,EastBoundingCoordinate:double,NorthBoundingCoordinate:double>>>>>>>>"


def granules(pages: DataFrame, most: int | None = 2000) -> DataFrame:
    """Granules of the answers of searches: (search, id, started, ended, cloud, ring, truncated).

    pages: (search, page, cursor, value). Pages are read in order until one has no cursor. A granule without a start is
    dropped; its ring is its first polygon, else its bounding rectangle. Of a search at most `most` granules are given
    (None: all), and truncated says whether it has more hits than were given. Pages without a search take no part.
    """
    from pyspark.sql import Window as W

    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def item(i):
        span, geometry = i["umm"]["TemporalExtent"]["RangeDateTime"], i["umm"]["SpatialExtent"]["HorizontalSpatialDomain"]["Geometry"]
        cloud = F.try_element_at(F.try_element_at(F.filter(i["umm"]["AdditionalAttributes"], lambda a: a["Name"] == "CLOUD_COVERAGE"), F.lit(1))["Values"], F.lit(1)).try_cast("double")
        points, box = F.try_element_at(geometry["GPolygons"], F.lit(1))["Boundary"]["Points"], F.try_element_at(geometry["BoundingRectangles"], F.lit(1))
        polygon = F.transform(points, lambda p: corner(p["Longitude"], p["Latitude"]))
        w, s, e, n = (box[f"{x}BoundingCoordinate"] for x in ("West", "South", "East", "North"))
        ring = F.coalesce(F.when(F.size(points) >= 3, polygon), F.when(w.isNotNull() & s.isNotNull() & e.isNotNull() & n.isNotNull(), F.array(corner(w, s), corner(e, s), corner(e, n), corner(w, n))))
        ident = F.coalesce(i["meta"]["concept-id"], i["umm"]["GranuleUR"], i["meta"]["native-id"], F.lit(""))
        started, ended = (F.try_to_timestamp(span[f"{x}DateTime"]) for x in ("Beginning", "Ending"))
        return F.struct(ident.alias("id"), started.alias("started"), F.coalesce(ended, started).alias("ended"), cloud.alias("cloud"), ring.alias("ring"))

    # answers are parsed once, where they are read, and only what is kept of them is shuffled and sorted, once
    parsed = pages.where("search is not null").select("search", "page", F.col("cursor").isNotNull().alias("_more"), F.inline_outer(F.array(F.from_json("value", _GRANULES))))
    kept = F.filter(F.transform("items", item), lambda i: i["started"].isNotNull())
    kept = parsed.select("search", "page", "_more", "hits", kept.alias("_items")).withColumn("_n", F.coalesce(F.size("_items"), F.lit(0)))
    whole = W.partitionBy("search")
    before = whole.orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    reached = kept.withColumn("_reached", F.coalesce(F.bool_and("_more").over(before), F.lit(True)))
    count = F.when(F.col("_reached"), F.col("_n")).otherwise(0)
    rows = reached.withColumn("_ahead", F.coalesce(F.sum(count).over(before), F.lit(0))).withColumn("_given", F.sum(count).over(whole)).where("_reached and _n > 0")
    if most is not None:
        left = F.least(F.col("_n"), F.greatest(F.lit(most) - F.col("_ahead"), F.lit(0))).cast("int")
        rows = rows.withColumn("_items", F.slice("_items", F.lit(1), left)).withColumn("_given", F.least("_given", F.lit(most)))
    return rows.select("search", (F.coalesce("hits", F.lit(0)) > F.col("_given")).alias("truncated"), F.inline("_items")).select("search", "id", "started", "ended", "cloud", "ring", "truncated")


def pages_until_done(pages: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The rows of paged answers (query, page, more, rows: array of structs), the first of each key of a query.

    Pages count in order up to the first that has no more, and no further than `most` (None: all).
    """
    from pyspark.sql import Window as W

    before = W.partitionBy("query").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    reached = pages.withColumn("_reached", F.coalesce(F.bool_and(F.coalesce("more", F.lit(False))).over(before), F.lit(True))).withColumn("_k", F.row_number().over(W.partitionBy("query").orderBy("page")))
    some = reached.where(F.col("_reached") if most is None else F.col("_reached") & (F.col("_k") <= most))
    rows = some.select("query", "page", F.posexplode("rows").alias("_at", "_r"))
    return rows.groupBy("query", F.col(f"_r.{key}").alias(key)).agg(F.min_by("_r", F.struct("page", "_at")).alias("_r")).select("query", "_r.*")
