"""Geometry on the sphere and on tiles as Column expressions; all stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii, which differ by use.
KM, MEAN_KM, MEAN_M, ROUND_M = 6371.0, 6371.0088, 6371008.8, 6371000.0
#: Metres in a foot, metres a second in a knot and in a foot a minute.
FOOT, KNOT, FOOT_A_MINUTE = 0.3048, 0.514444, 0.00508


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine(lat1, lon1, lat2, lon2, radius: float = KM) -> Column:
    """Great-circle distance in the radius's unit."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp, dl = (b - a) / 2, F.radians(_c(lon2) - _c(lon1)) / 2
    h = F.sin(dp) * F.sin(dp) + F.cos(a) * F.cos(b) * F.sin(dl) * F.sin(dl)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def half_up(number, digits: int) -> Column:
    """A number from 0 to 1e15 / 10**digits to so many digits, halves up, as DuckDB does; F.round makes a decimal of each."""
    scaled = _c(number) * 10.0**digits
    whole = F.floor(scaled).cast("double")
    return F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole) / 10.0**digits


def flat_distance(lat1, lon1, lat2, lon2, radius: float = ROUND_M) -> Column:
    """Equirectangular distance, for short ones."""
    x = F.radians(_c(lon2) - _c(lon1)) * F.cos(F.radians((_c(lat1) + _c(lat2)) / 2))
    y = F.radians(_c(lat2) - _c(lat1))
    return radius * F.sqrt(x * x + y * y)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def cross_track(lat, lon, lat1, lon1, lat2, lon2, radius: float = KM) -> Column:
    """Signed distance of a point from the great circle through two others (right of it is positive)."""
    d = haversine(lat1, lon1, lat, lon, 1.0)
    return radius * F.asin(F.sin(d) * F.sin(F.radians(bearing(lat1, lon1, lat, lon) - bearing(lat1, lon1, lat2, lon2))))


def destination(lat, lon, degrees, distance, radius: float = ROUND_M) -> tuple[Column, Column]:
    """(lat, lon) after a distance along a bearing."""
    a, t, d = F.radians(_c(lat)), F.radians(_c(degrees)), _c(distance) / radius
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    east = F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), wrap_lon(_c(lon) + F.degrees(east))


def between(lat1, lon1, lat2, lon2, part) -> tuple[Column, Column]:
    """(lat, lon) at a part (0 to 1) of the great circle between two points."""
    d, f = haversine(lat1, lon1, lat2, lon2, 1.0), _c(part)
    a = F.when(d == 0, 1 - f).otherwise(F.sin((1 - f) * d) / F.sin(d))
    b = F.when(d == 0, f).otherwise(F.sin(f * d) / F.sin(d))
    p, q, l, m = (F.radians(_c(x)) for x in (lat1, lat2, lon1, lon2))  # noqa: E741
    x = a * F.cos(p) * F.cos(l) + b * F.cos(q) * F.cos(m)
    y = a * F.cos(p) * F.sin(l) + b * F.cos(q) * F.sin(m)
    z = a * F.sin(p) + b * F.sin(q)
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def wrap_lon(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_c(lon) + 180, F.lit(360.0)) - 180


def tile_x(lon, zoom: int) -> Column:
    return F.least(F.greatest(F.floor((_c(lon) + 180) / 360 * 2**zoom), F.lit(0)), F.lit(2**zoom - 1))


def tile_y(lat, zoom: int) -> Column:
    r = F.radians(F.least(F.greatest(_c(lat), F.lit(-85.05112878)), F.lit(85.05112878)))
    return F.least(F.greatest(F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * 2**zoom), F.lit(0)), F.lit(2**zoom - 1))


def tile_lon(x, zoom: int) -> Column:
    return _c(x) / 2**zoom * 360 - 180


def tile_lat(y, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * _c(y) / 2**zoom))))


def valid_point(lat, lon) -> Column:
    """Whether both are numbers on the globe."""
    ok = lambda x, most: x.isNotNull() & ~F.isnan(x) & x.between(-most, most)
    return ok(_c(lat).cast("double"), 90) & ok(_c(lon).cast("double"), 180)


def in_box(lat, lon, west, south, east, north) -> Column:
    """Box membership, borders included; a box with west > east crosses the dateline."""
    width = F.pmod(_c(east) - _c(west) + 360, F.lit(360.0))
    width = F.when((width == 0) & (_c(east) != _c(west)), 360.0).otherwise(width)
    return _c(lat).between(_c(south), _c(north)) & (F.pmod(_c(lon) - _c(west) + 360, F.lit(360.0)) <= width)


def boxes_overlap(a, b) -> Column:
    """Whether two (west, south, east, north) boxes touch."""
    (w, s, e, n), (x, t, f, m) = (tuple(map(_c, x)) for x in (a, b))
    return (w <= f) & (e >= x) & (s <= m) & (n >= t)


def box_inside(a, b) -> Column:
    """Whether the first (west, south, east, north) box lies within the second, borders included."""
    (w, s, e, n), (x, t, f, m) = (tuple(map(_c, x)) for x in (a, b))
    return (w >= x) & (e <= f) & (s >= t) & (n <= m)


def snap_out(low, high, step: float) -> tuple[Column, Column]:
    """An interval widened to multiples of step."""
    return F.floor(_c(low) / step) * step, F.ceil(_c(high) / step) * step


def wind(u, v) -> tuple[Column, Column]:
    """Speed, and the direction that the wind comes from in degrees; calm air comes from 180, as IEEE's atan2 has it.

    Spark's atan2 takes -0.0 for 0.0, so the sign of a zero is told by its text: only v = -0.0 comes from 0.
    """
    u, v = _c(u), _c(v)
    calm = F.when(v.cast("double").cast("string") == "-0.0", 0.0).otherwise(180.0)
    return F.hypot(u, v), F.when((u == 0) & (v == 0), calm).otherwise(F.pmod(F.degrees(F.atan2(-u, -v)) + 360, F.lit(360.0)))


#: The sixteen points of the compass.
POINTS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def compass(degrees) -> Column:
    return F.element_at(F.array(*map(F.lit, POINTS)), F.pmod(F.floor(_c(degrees) / 22.5 + 0.5).cast("int"), F.lit(16)) + 1)


def cell(lat, lon, size: float) -> tuple[Column, Column]:
    """Row and column of a regular grid of degrees."""
    return F.floor(_c(lat) / size).cast("long"), F.floor(_c(lon) / size).cast("long")


def manhattan(lat1, lon1, lat2, lon2, radius: float = KM) -> Column:
    """North-south plus east-west distance along the first parallel."""
    return haversine(lat1, lon1, lat2, lon1, radius) + haversine(lat1, lon1, lat1, lon2, radius)


def ring_area(ring) -> Column:
    """Signed area of an array of structs (x, y), ring closed or not; anticlockwise is positive."""
    r = _c(ring)
    shifted = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.aggregate(F.zip_with(r, shifted, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x) / 2


def in_ring(x, y, ring) -> Column:
    """Whether a point is inside an array of structs (x, y), by crossings."""
    x, y, r = _c(x), _c(y), _c(ring)
    shifted = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    crosses = F.zip_with(r, shifted, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]))
    return F.aggregate(crosses, F.lit(False), lambda a, c: a != F.coalesce(c, F.lit(False)))


def crossed_oddly(x, y, edges) -> Column:
    """Whether an odd number of edges (structs px, py, qx, qy) lies right of a point; `in_ring` for a part of a ring."""
    x, y = _c(x), _c(y)
    crosses = lambda e: ((e["py"] > y) != (e["qy"] > y)) & (x < (e["qx"] - e["px"]) * (y - e["py"]) / F.nullif(e["qy"] - e["py"], F.lit(0.0)) + e["px"])
    return F.aggregate(_c(edges), F.lit(False), lambda a, e: a != F.coalesce(crosses(e), F.lit(False)))


def ring_centroid(ring) -> tuple[Column, Column]:
    """Centroid by area; the mean vertex where the area is 0."""
    r = _c(ring)
    shifted = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    area = ring_area(ring)
    total = lambda k: F.aggregate(F.zip_with(r, shifted, lambda p, q: (p[k] + q[k]) * (p["x"] * q["y"] - q["x"] * p["y"])), F.lit(0.0), lambda a, v: a + v)
    mean = lambda k: F.aggregate(r, F.lit(0.0), lambda a, p: a + p[k]) / F.size(r)
    return tuple(F.when(area == 0, mean(k)).otherwise(total(k) / (6 * area)) for k in ("x", "y"))


def to_segment(x, y, x1, y1, x2, y2) -> Column:
    """Plane distance of a point from a segment."""
    x, y, x1, y1, x2, y2 = map(_c, (x, y, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def bilinear(v00, v10, v01, v11, fx, fy) -> Column:
    """Value within a cell; vXY is the corner at (x, y), fx and fy in 0 to 1."""
    a, b, c, d, fx, fy = map(_c, (v00, v10, v01, v11, fx, fy))
    return a * (1 - fx) * (1 - fy) + b * fx * (1 - fy) + c * (1 - fx) * fy + d * fx * fy


def seeds(k, n) -> tuple[Column, Column]:
    """(lat, lon) of point k of n spread evenly over the globe by the golden angle."""
    k, n = _c(k), _c(n)
    lat = F.degrees(F.asin(((k + 0.5) / n * 2 - 1) * math.sin(math.radians(88))))
    return lat, F.pmod(k * 137.50776405003785 + 180, F.lit(360.0)) - 180


def rounded(coordinates, depth: int, digits: int = 6) -> Column:
    """Arrays of numbers nested so deep, every number rounded."""
    inner = (lambda x: F.round(x, digits)) if depth == 1 else (lambda x: rounded(x, depth - 1, digits))
    return F.transform(_c(coordinates), inner)


def mean_vertex(points) -> tuple[Column, Column]:
    """The mean of the vertices of an array of structs (x, y)."""
    p = _c(points)
    return tuple(F.aggregate(p, F.lit(0.0), lambda a, q: a + q[k]) / F.nullif(F.size(p), F.lit(0)) for k in ("x", "y"))


def collapsed(polygons) -> Column:
    """Polygon or MultiPolygon as a struct (type, polygons): rings without four points go, then polygons without rings; null if none is left."""
    kept = F.filter(F.transform(_c(polygons), lambda rings: F.filter(rings, lambda r: F.size(r) >= 4)), lambda rings: F.size(rings) > 0)
    return F.when(F.size(kept) > 0, F.struct(F.when(F.size(kept) == 1, "Polygon").otherwise("MultiPolygon").alias("type"), kept.alias("polygons")))


#: Boxes (west, south, east, north) around the parts of the United States; Alaska crosses the dateline.
US_BOXES = {"conus": (-125.0, 24.3, -66.9, 49.5), "alaska": (172.0, 51.0, -129.9, 71.5), "hawaii": (-160.6, 18.8, -154.7, 22.4), "puerto rico": (-68.0, 17.6, -64.5, 18.6)}


def us_box(lat, lon) -> Column:
    """The part of the United States whose box holds a point, or null; the outline itself is a ring join (`points_in_rings`)."""
    return F.coalesce(*(F.when(in_box(lat, lon, F.lit(w), F.lit(s), F.lit(e), F.lit(n)), name) for name, (w, s, e, n) in US_BOXES.items()))
