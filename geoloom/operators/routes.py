"""Roads, flows and routes: line matching and plausibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators.joins import _cells, cell_of

#: Metres and degrees that a flow may be off a road, and the share of a road's samples that must match.
NEAR_M, TURN, LEAST_SHARE = 35.0, 30.0, 0.5
#: Kilometres of a plausible route: from an endpoint, off the great circle, for climb or descent.
ENDPOINT_KM, TRACK_KM, TERMINAL_KM = 130.0, 200.0, 130.0


def samples(lines: DataFrame, key: str) -> DataFrame:
    """(key, x, y, heading) of the middle of each segment of lines (key, coords: array of structs (lon, lat))."""
    at = F.explode(F.sequence(F.lit(1), F.size("coords") - 1))
    seg = lines.where("size(coords) > 1").select(*[c for c in lines.columns if c != "coords"], "coords", at.alias("_i"))
    a, b = F.element_at("coords", F.col("_i")), F.element_at("coords", F.col("_i") + 1)
    s = seg.select("*", a.alias("_a"), b.alias("_b"))
    return s.select(*[c for c in lines.columns if c != "coords"], ((F.col("_a.lon") + F.col("_b.lon")) / 2).alias("lon"), ((F.col("_a.lat") + F.col("_b.lat")) / 2).alias("lat"), geo.bearing("_a.lat", "_a.lon", "_b.lat", "_b.lon").alias("heading"))


def matched_flows(roads: DataFrame, flows: DataFrame, cell: float = 0.001) -> DataFrame:
    """(road, level, closed) of roads (road, oneway, coords) that flows (level, closure, coords) run along.

    Samples of both meet in cells; a flow sample counts for a road sample within NEAR_M whose heading agrees (either way
    unless the road is one-way). A road needs half of its samples matched; its level is the median of theirs. A road's
    sample is copied to the cells that its reach touches, at any latitude. All joins are shuffled: the lines' sizes on
    disk say nothing of the number of their samples, so neither side may be sent to the driver on that ground.
    """
    r = samples(roads, "road").withColumn("_s", F.monotonically_increasing_id())
    f = samples(flows, "flow").select("level", "closure", F.col("lon").alias("flon"), F.col("lat").alias("flat"), F.col("heading").alias("fheading"))
    placed = r.withColumn("_cell", F.explode(_cells(F.col("lat"), F.col("lon"), 1.03 * NEAR_M / 1000, cell)))
    f = f.withColumn("_cell", cell_of(F.col("flat"), F.col("flon"), cell))
    turn = F.abs(F.pmod(F.col("heading") - F.col("fheading") + 180, F.lit(360.0)) - 180)
    ok = (geo.flat_distance("lat", "lon", "flat", "flon") <= NEAR_M) & ((turn <= TURN) | ((turn >= 180 - TURN) & ~F.coalesce("oneway", F.lit(False))))
    hit = placed.join(f.hint("merge"), "_cell").where(ok).groupBy("road", "_s").agg(F.median("level").alias("level"), F.max("closure").alias("closed"))
    total = r.groupBy("road").agg(F.count(F.lit(1)).alias("of"))
    found = hit.groupBy("road").agg(F.median("level").alias("level"), F.max("closed").alias("closed"), F.count(F.lit(1)).alias("n"))
    return found.join(total.hint("merge"), "road").where(F.col("n") >= LEAST_SHARE * F.col("of")).select("road", "level", "closed")


def plausible(lat, lon, climb, lat1, lon1, lat2, lon2) -> Column:
    """Whether a position fits a route: near an end, or near its great circle; climbing or sinking only towards the ends."""
    start, end = geo.haversine(lat, lon, lat1, lon1), geo.haversine(lat, lon, lat2, lon2)
    near = F.least(start, end) < ENDPOINT_KM
    along = (F.abs(geo.cross_track(lat, lon, lat1, lon1, lat2, lon2)) < TRACK_KM) & (F.greatest(start, end) < geo.haversine(lat1, lon1, lat2, lon2) + TRACK_KM)
    c = F.col(climb) if isinstance(climb, str) else climb
    level = F.abs(F.coalesce(c, F.lit(0.0))) < 5
    return near | (along & (level | (F.least(start, end) < 2 * TERMINAL_KM)))


def route_steps(routes: DataFrame, most: int | None = 200) -> DataFrame:
    """(route, step, kind, name, metres) of routes (route, legs: array of arrays of (kind, name, metres)), flattened.

    Leaving a roundabout belongs to the step that enters it: its metres are added and its name is taken.
    """
    flat = routes.select("route", F.posexplode(F.flatten("legs")).alias("_at", "s")).select("route", "_at", "s.kind", "s.name", "s.metres")
    own = W.partitionBy("route").orderBy("_at")
    exits = (F.col("kind") == "exit roundabout") & F.lag("kind").over(own).isin("roundabout", "rotary")
    group = F.sum(F.when(exits, 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, 0))
    joined = flat.withColumn("_x", exits).withColumn("step", group).groupBy("route", "step").agg(F.min_by("kind", "_at").alias("kind"), F.max_by("name", "_at").alias("name"), F.sum("metres").alias("metres"))
    return joined if most is None else joined.where(F.col("step") <= most)


def along_line(segments: DataFrame, line: str, order: list[str], length: str, at) -> DataFrame:
    """(line, segment, fraction): the segment of each line, counted from 1, that holds a distance, and how far along it.

    Lines that are shorter have no row; a distance where two segments meet is at the end of the first one.
    """
    w = W.partitionBy(line).orderBy(*order)
    upto = F.sum(length).over(w.rowsBetween(W.unboundedPreceding, 0))
    at = at if isinstance(at, Column) else F.lit(at)
    s = segments.withColumns({"_upto": upto, "_segment": F.row_number().over(w).cast("long")}).where(F.col("_upto") >= at)
    inside = (at - F.col("_upto") + F.col(length)) / F.nullif(F.col(length), F.lit(0))
    return s.groupBy(line).agg(F.min("_segment").alias("segment"), F.min_by(F.coalesce(inside, F.lit(0.0)), "_segment").alias("fraction"))
