"""Rings and lines in batches: hulls, simplification, clipping, clean-up; and inverse map projections as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

_RING = ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType()))


def _points(ring) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in ring] if ring is not None else []


def _ring(points) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, anticlockwise from the leftmost point, not closed; fewer than three points are returned sorted."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def chain(ps):
        out: list = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return chain(p) + chain(p[::-1])


def simplified(points: list[tuple[float, float]], tolerance: float, infinite: bool = False) -> list[tuple[float, float]]:
    """Douglas-Peucker: the points that are further than the tolerance from the segment (or infinite line) of those kept."""
    if len(points) < 3:
        return points
    a = points if len(points) <= FEW else np.array(points)
    keep = {0, len(a) - 1}
    todo = [(0, len(a) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        k, away = (_furthest if len(points) <= FEW else _furthest_of_many)(a, i, j, infinite)
        if away > tolerance:
            keep.add(k)
            todo += [(i, k), (k, j)]
    return [points[k] for k in sorted(keep)]


#: Points up to which a line is walked without arrays, which cost more than they save there.
FEW = 64


def _furthest(a, i: int, j: int, infinite: bool) -> tuple[int, float]:
    """Which point between two of a short line is furthest from what joins them, and how far."""
    (x, y), (u, v) = a[i], a[j]
    dx, dy = u - x, v - y
    n = dx * dx + dy * dy
    best, most = i + 1, -1.0
    for k in range(i + 1, j):
        px, py = a[k][0] - x, a[k][1] - y
        if n:
            along = (px * dx + py * dy) / n
            along = along if infinite else min(max(along, 0.0), 1.0)
            px, py = px - along * dx, py - along * dy
        away = math.hypot(px, py)
        if away > most:
            best, most = k, away
    return best, most


def _furthest_of_many(a: np.ndarray, i: int, j: int, infinite: bool) -> tuple[int, float]:
    d, q = a[j] - a[i], a[i + 1 : j] - a[i]
    n = float(d @ d)
    if n:
        along = q @ d / n
        along = along if infinite else np.clip(along, 0, 1)
        q = q - along[:, None] * d
    away = np.hypot(*q.T)
    k = int(away.argmax())
    return i + 1 + k, float(away[k])


def clipped(line: list[tuple[float, float]], west: float, south: float, east: float, north: float) -> list[list[tuple[float, float]]]:
    """The parts of a line within a box."""
    out: list = []
    for (x, y), (u, v) in zip(line, line[1:]):
        lo, hi, dx, dy = 0.0, 1.0, u - x, v - y
        for p, q in ((-dx, x - west), (dx, east - x), (-dy, y - south), (dy, north - y)):
            if p == 0:
                if q < 0:
                    hi = -1.0
            elif p < 0:
                lo = max(lo, q / p)
            else:
                hi = min(hi, q / p)
        if lo > hi:
            continue
        a, b = (x + lo * dx, y + lo * dy), (x + hi * dx, y + hi * dy)
        if out and out[-1][-1] == a:
            out[-1].append(b)
        else:
            out.append([a, b])
    return out


def cleaned(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A closed ring without repeated neighbours; empty if fewer than three corners are left."""
    out = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    if out and out[0] == out[-1]:
        out = out[:-1]
    return [*out, out[0]] if len(out) > 2 else []


def hull_udf(ring: Column) -> Column:
    return _mapped(hull)(ring)


def simplify_udf(ring: Column, tolerance: float, infinite: bool = False) -> Column:
    return _mapped(lambda p: simplified(p, tolerance, infinite))(ring)


def clean_udf(ring: Column) -> Column:
    return _mapped(cleaned)(ring)


def _mapped(f):
    def mapped(rings: pa.Array) -> pa.Array:
        flat = rings.flatten()
        x, y = flat.field("x").to_pylist(), flat.field("y").to_pylist()
        ends, points, at = [0], [], 0
        for n in pc.list_value_length(rings).to_pylist():
            points += f(list(zip(x[at : at + (n or 0)], y[at : at + (n or 0)])))
            ends.append(len(points))
            at += n or 0
        xy = [pa.array([p[k] for p in points], pa.float64()) for k in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(xy, ["x", "y"]))

    return F.arrow_udf(mapped, _RING)


def hulls(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, n, ring) of each group: hulls of parts are made first and joined, so no group is gathered whole."""
    schema = points.select(*by).schema

    def part(batches):
        for b in batches:
            for key, g in b.groupby(by, dropna=False, sort=False):
                h = hull(list(zip(g["_x"], g["_y"])))
                yield pd.DataFrame([dict(zip(by, key if isinstance(key, tuple) else (key,)), n=int(g["_n"].sum()), ring=_ring(h))])

    out = StructType([*schema.fields]).add("n", "long").add("ring", _RING)
    first = points.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(1).alias("_n")).mapInPandas(part, out)

    def joined(g):
        h = hull([p for r in g["ring"] for p in _points(r)])
        return pd.DataFrame([dict({c: g[c].iloc[0] for c in by}, n=int(g["n"].sum()), ring=_ring(h))])

    return first.groupBy(*by).applyInPandas(joined, out)


#: Semi-major axis and eccentricity of the 1980 and 1866 ellipsoids.
GRS80, CLARKE66 = (6378137.0, 0.0818191910428), (6378206.4, 0.0822718542230)


def lambert_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float, lon0: float, x0: float, y0: float, ellipsoid=GRS80) -> tuple[Column, Column]:
    """(lat, lon) of Lambert conformal conic coordinates in metres; the latitude is refined five times."""
    a, e = ellipsoid
    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = m(p1) / (n * t(p1) ** n)
    r0 = a * big * t(p0) ** n
    dx, dy = x - x0, F.lit(r0) - (y - y0)
    tt = F.pow(F.hypot(dx, dy) / (a * big), F.lit(1 / n))
    lat = math.pi / 2 - 2 * F.atan(tt)
    for _ in range(5):
        s = e * F.sin(lat)
        lat = math.pi / 2 - 2 * F.atan(tt * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return F.degrees(lat), F.degrees(F.atan2(dx, dy) / n) + lon0


def albers_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float, lon0: float, radius: float = 6371007.181) -> tuple[Column, Column]:
    """(lat, lon) of Albers equal-area conic coordinates on a sphere, in metres."""
    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    r0 = radius * math.sqrt(c - 2 * n * math.sin(p0)) / n
    dy = F.lit(r0) - y
    r = F.hypot(x, dy)
    return F.degrees(F.asin((c - F.pow(r * n / radius, F.lit(2))) / (2 * n))), F.degrees(F.atan2(x, dy) / n) + lon0


def streamline(u, v, lon: float, lat: float, steps: int, seconds: float) -> list[tuple[float, float]]:
    """Points of a path through a wind field by midpoint steps; u(lon, lat) and v(lon, lat) in metres a second."""
    out = [(lon, lat)]
    scale = seconds / 111_195.0
    for _ in range(steps):
        c = max(0.05, math.cos(math.radians(lat)))
        mx, my = lon + u(lon, lat) * scale / c / 2, lat + v(lon, lat) * scale / 2
        lon, lat = lon + u(mx, my) * scale / c, lat + v(mx, my) * scale
        lon = (lon + 180) % 360 - 180
        if abs(lat) > 89:
            break
        out.append((lon, lat))
    return out
