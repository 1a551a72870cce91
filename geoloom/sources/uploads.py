"""Uploaded files of any of the known kinds as rows: tables, GeoJSON, KML, GPX, shapefiles, and archives of them.

A file is read by its ending, in a task; archives are opened first (`feeds.unpacked` bounds them), and a zipped shapefile is
read from its parts. A row is a map of its properties, as texts, and a geometry as GeoJSON: what the file gives, or for
tables a point where two columns hold coordinates. A file that cannot be read gives one row that says why.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources import feeds, tabular

#: Names of coordinate columns, compared without case.
LATITUDES, LONGITUDES = ("latitude", "lat", "y"), ("longitude", "lon", "lng", "long", "x")

ROWS = "path string, name string, kind string, place int, properties map<string,string>, geometry string, problem string"


def _text(v) -> str | None:
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def _number(v, most: float) -> float | None:
    try:
        x = float(v)
    except (TypeError, ValueError):
        return None
    return x if abs(x) <= most else None


def _with_points(rows: list[dict]) -> list[tuple[dict, dict | None]]:
    """Rows with a point where a latitude and a longitude column hold numbers."""
    lower = {c.strip().lower(): c for c in (rows[0] if rows else {})}
    lat = next((lower[c] for c in LATITUDES if c in lower), None)
    lon = next((lower[c] for c in LONGITUDES if c in lower), None)
    out = []
    for r in rows:
        y, x = (_number(r[lat], 90), _number(r[lon], 180)) if lat and lon else (None, None)
        out.append((r, {"type": "Point", "coordinates": [x, y]} if x is not None and y is not None else None))
    return out


def table_rows(data: bytes, tabs: bool = False) -> list[tuple[dict, dict | None]]:
    """A delimited table: BOM, quoted cells and either line end; the delimiter that the header has most of."""
    text = data.decode("utf-8-sig", "replace")
    head = text.split("\n", 1)[0]
    delimiter = "\t" if tabs else max(",;\t|", key=head.count)
    lines = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r)]
    if not lines:
        return []
    names = tabular.unique_headers(lines[0])
    return _with_points([{n: (r[k] if k < len(r) and r[k] != "" else None) for k, n in enumerate(names)} for r in lines[1:]])


def workbook_rows(data: bytes) -> list[tuple[dict, dict | None]]:
    rows = [r for r in tabular.xlsx_rows(data) if any(c is not None and c != "" for c in r)]
    if not rows:
        return []
    names = tabular.unique_headers(rows[0])
    return _with_points([{n: _text(r[k]) if k < len(r) else None for k, n in enumerate(names)} for r in rows[1:]])


def geojson_rows(data: bytes) -> list[tuple[dict, dict | None]]:
    """Features of a collection, a feature, or a bare geometry."""
    found = json.loads(data.decode("utf-8-sig"))
    if not isinstance(found, dict):
        raise ValueError("not GeoJSON")
    if found.get("type") == "FeatureCollection":
        features = found.get("features") or []
    elif found.get("type") == "Feature":
        features = [found]
    elif "coordinates" in found or "geometries" in found:
        features = [{"geometry": found}]
    else:
        raise ValueError("not GeoJSON")
    return [({k: _text(v) for k, v in (f.get("properties") or {}).items()}, f.get("geometry")) for f in features if isinstance(f, dict)]


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _inner(e, *names: str) -> list:
    """Elements within one by their local names, a name a level, at any depth."""
    found = [e]
    for n in names:
        found = [x for f in found for x in f.iter() if _local(x) == n and x is not f]
    return found


def _coordinates(text: str | None) -> list[list[float]]:
    return [[float(v) for v in p.split(",")[:2]] for p in (text or "").split()]


def _kml_geometry(e) -> dict | None:
    kind = _local(e)
    texts = lambda x: next((c.text for c in _inner(x, "coordinates")), "")
    if kind == "Point":
        at = _coordinates(texts(e))
        return {"type": "Point", "coordinates": at[0]} if at else None
    if kind in ("LineString", "LinearRing"):
        return {"type": "LineString", "coordinates": _coordinates(texts(e))}
    if kind == "Polygon":
        rings = [_coordinates(texts(b)) for name in ("outerBoundaryIs", "innerBoundaryIs") for b in _inner(e, name)]
        return {"type": "Polygon", "coordinates": rings} if rings else None
    if kind == "MultiGeometry":
        parts = [g for g in map(_kml_geometry, e) if g]
        return {"type": "GeometryCollection", "geometries": parts} if parts else None
    return None


def kml_rows(data: bytes) -> list[tuple[dict, dict | None]]:
    """Placemarks with name, description, extended data and geometry."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            name = next((n for n in z.namelist() if n.lower().endswith(".kml")), None)
            if name is None:
                raise ValueError("no KML in the archive")
            data = z.read(name)
    out = []
    for p in _inner(ElementTree.fromstring(data), "Placemark"):
        props = {_local(c): (c.text or "").strip() for c in p if _local(c) in ("name", "description")}
        for d in _inner(p, "Data"):
            props[d.get("name", "")] = next(((v.text or "").strip() for v in _inner(d, "value")), None)
        for d in _inner(p, "SimpleData"):
            props[d.get("name", "")] = (d.text or "").strip()
        out.append((props, next((g for g in map(_kml_geometry, p) if g), None)))
    return out


def gpx_rows(data: bytes) -> list[tuple[dict, dict | None]]:
    """Waypoints as points, routes as lines, tracks as lines of their segments; a point without valid coordinates goes."""
    out = []
    at = lambda e: (_number(e.get("lon"), 180), _number(e.get("lat"), 90))
    line = lambda parent, name: [list(p) for p in map(at, (c for c in parent if _local(c) == name)) if None not in p]
    for e in ElementTree.fromstring(data):
        kind = _local(e)
        props = {_local(c): (c.text or "").strip() for c in e if _local(c) in ("name", "desc", "cmt", "time", "ele", "sym", "type")}
        if kind == "wpt":
            p = at(e)
            out.append((props, {"type": "Point", "coordinates": list(p)} if None not in p else None))
        elif kind == "rte":
            out.append((props, {"type": "LineString", "coordinates": line(e, "rtept")}))
        elif kind == "trk":
            segments = [s for s in (line(c, "trkpt") for c in e if _local(c) == "trkseg") if s]
            out.append((props, {"type": "MultiLineString", "coordinates": segments} if segments else None))
    return out


def shapefile_rows(parts: dict[str, bytes]) -> list[tuple[dict, dict | None]]:
    """Polygons of a .shp with the rows of the .dbf beside it, by ending."""
    shapes = tabular.shp_shapes(parts["shp"])
    table = tabular.dbf_table(parts["dbf"]) if "dbf" in parts else pd.DataFrame(index=range(len(shapes)))
    out = []
    for props, rings in zip(table.to_dict("records"), shapes):
        polygons = [[[list(p) for p in r] for r in group] for group in tabular.polygons(rings)] if rings else []
        out.append(({k: _text(v) for k, v in props.items()}, {"type": "MultiPolygon", "coordinates": polygons} if polygons else None))
    return out


_READERS = {"csv": table_rows, "tsv": lambda d: table_rows(d, True), "xlsx": workbook_rows, "geojson": geojson_rows, "kml": kml_rows, "gpx": gpx_rows}


def upload_rows(name: str, data: bytes):
    """(file in an archive or the name itself, kind, place, properties, geometry, problem) of each row of an upload."""
    kind = feeds.kind_of(name) or ("csv" if name.lower().endswith(".txt") else None)
    try:
        files = feeds.unpacked(name, data) if kind == "archive" else [(name, data)]
    except Exception as e:  # noqa: BLE001  what a file holds is not ours to trust
        yield name, kind, 0, None, None, f"{type(e).__name__}: {e}"
        return
    shapes = {n[: -len(".shp")] for n, _ in files if n.lower().endswith(".shp")}
    held = {n.rsplit(".", 1)[0] + "." + n.rsplit(".", 1)[-1].lower(): d for n, d in files if "." in n}
    for inner, content in files:
        stem = inner.rsplit(".", 1)[0]
        own = feeds.kind_of(inner) or ("csv" if inner.lower().endswith(".txt") else None)
        if stem in shapes and own != "shapefile":
            continue  # a part of a shapefile
        try:
            if own == "shapefile":
                rows = shapefile_rows({e: held[f"{stem}.{e}"] for e in ("shp", "dbf") if f"{stem}.{e}" in held})
            elif own in _READERS:
                rows = _READERS[own](content)
            elif kind == "archive":
                continue  # what else an archive holds
            else:
                raise ValueError("no reader for such a name")
            for place, (props, geometry) in enumerate(rows):
                yield inner, own, place, props, geometry, None
        except Exception as e:  # noqa: BLE001
            yield inner, own, 0, None, None, f"{type(e).__name__}: {e}"


def read_uploads(files: DataFrame) -> DataFrame:
    """Rows of uploaded files (path, content): path, name, kind, place, properties, geometry, problem."""

    def read(r):
        for name, kind, place, props, geometry, problem in upload_rows(r["path"].rsplit("/", 1)[-1], r["content"]):
            yield r["path"], name, kind, place, None if props is None else list(props.items()), json.dumps(geometry) if geometry else None, problem

    text = pa.string()
    fields = [("path", text), ("name", text), ("kind", text), ("place", pa.int32()), ("properties", pa.map_(text, text)), ("geometry", text), ("problem", text)]
    return files.select("path", "content").mapInArrow(feeds.in_turn(read, fields), ROWS)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """One upload, or all under a path, as a table: a text column for each property that a row has, geometry, problem."""
    rows = read_uploads(spark.read.format("binaryFile").load(path))
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("properties"))).distinct().collect())  # column names
    taken = {"name", "geometry", "problem"}
    return rows.select(F.col("name").alias("_file"), *(F.col("properties").getItem(n).alias(n if n not in taken - {"name"} else f"{n}_2") for n in names), "geometry", "problem")
