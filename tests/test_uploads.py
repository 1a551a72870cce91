"""Uploads of each kind, alone and in archives, and files that cannot be read."""

import io
import json
import zipfile

import pandas as pd
import pytest

from geoloom.sources import sinks, tabular, uploads


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in files.items():
            z.writestr(n, d)
    return out.getvalue()


KML = b"""<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>Here</name><ExtendedData><Data name="k"><value>5</value></Data></ExtendedData><Point><coordinates>-80.5,25.25,0</coordinates></Point></Placemark>
<Placemark><name>Area</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 4,0 4,4 0,0</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,2 1,1</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
<Placemark><MultiGeometry><Point><coordinates>1,2</coordinates></Point><LineString><coordinates>1,2 3,4</coordinates></LineString></MultiGeometry></Placemark></Document></kml>"""
GPX = b"""<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="25.5" lon="-80.1"><name>A</name><ele>3</ele></wpt><wpt lat="95" lon="1"><name>bad</name></wpt><rte><name>R</name><rtept lat="1" lon="2"/><rtept lat="3" lon="4"/></rte><trk><name>T</name><trkseg><trkpt lat="1" lon="2"/><trkpt lat="x" lon="2"/><trkpt lat="2" lon="3"/></trkseg><trkseg/></trk></gpx>"""


def rows(name, data):
    return [(n, k, p, props, g, bool(problem)) for n, k, p, props, g, problem in uploads.upload_rows(name, data)]


def test_tables():
    text = "﻿Name;Lat;LNG\r\n\"a;\"\"b\"\"\r\n\";25.5;-80\r\n;x;1\r\n\r\nc;91;2".encode()
    assert rows("a.CSV", text) == [("a.CSV", "csv", 0, {"Name": 'a;"b"\r\n', "Lat": "25.5", "LNG": "-80"}, {"type": "Point", "coordinates": [-80.0, 25.5]}, False), ("a.CSV", "csv", 1, {"Name": None, "Lat": "x", "LNG": "1"}, None, False), ("a.CSV", "csv", 2, {"Name": "c", "Lat": "91", "LNG": "2"}, None, False)]
    assert rows("a.tsv", b"a\tb\n1,2\t3")[0][3] == {"a": "1,2", "b": "3"} and rows("a.txt", b"a,b\n1,2")[0][1] == "csv"
    assert rows("a.csv", b"") == [] and rows("a.csv", b"only,a,header") == []
    book = sinks.workbook({"s": pd.DataFrame({"id": ["x", "y"], "latitude": [1.5, 2.0], "longitude": [3.0, None]})})
    got = rows("b.xlsx", book)
    assert [g for *_, g, _ in got] == [{"type": "Point", "coordinates": [3.0, 1.5]}, None] and got[1][3]["latitude"] == "2"


def test_shapes():
    feature = {"type": "Feature", "properties": {"n": 1, "s": "é", "none": None, "l": [1]}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    collection = json.dumps({"type": "FeatureCollection", "features": [feature, {"type": "Feature", "properties": None, "geometry": None}]}).encode()
    assert [r[3:5] for r in rows("a.geojson", collection)] == [({"n": "1", "s": "é", "none": None, "l": "[1]"}, feature["geometry"]), ({}, None)]
    assert rows("a.json", json.dumps(feature["geometry"]).encode())[0][4] == feature["geometry"]
    for name, data in (("a.kml", KML), ("a.kmz", zipped({"doc.kml": KML}))):
        got = rows(name, data)
        assert got[0][3] == {"name": "Here", "k": "5"} and got[0][4] == {"type": "Point", "coordinates": [-80.5, 25.25]}
        assert [len(r) for r in got[1][4]["coordinates"]] == [4, 4] and [g["type"] for g in got[2][4]["geometries"]] == ["Point", "LineString"]
    got = rows("a.gpx", GPX)
    assert [g and g["type"] for *_, g, _ in got] == ["Point", None, "LineString", "MultiLineString"]
    assert got[0][3] == {"name": "A", "ele": "3"} and got[3][4]["coordinates"] == [[[2.0, 1.0], [3.0, 2.0]]]


def test_archives_and_what_cannot_be_read():
    square = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]]
    parts = tabular.shapefile([("12345", [square])])
    named = {f"in/areas.{e.lstrip('.')}": d for e, d in parts.items()}
    got = rows("x.zip", zipped({**named, "in/t.csv": b"a\n1", "in/readme.md": b"# no"}))
    assert [(r[0], r[1]) for r in got] == [("in/areas.shp", "shapefile"), ("in/t.csv", "csv")]
    assert got[0][3]["GEOID"] == "12345" and got[0][4]["type"] == "MultiPolygon"
    import gzip

    assert rows("t.csv.gz", gzip.compress(b"a\n1"))[0][3] == {"a": "1"}
    for name, data in (("a.geojson", b"{"), ("a.geojson", b"[]"), ("a.kml", b"<kml>"), ("a.xlsx", b"PK"), ("a.zip", b"no"), ("a.doc", b"x"), ("a.kmz", zipped({"a.txt": b""}))):
        found = rows(name, data)
        assert len(found) == 1 and found[0][5], name


def test_uploads_in_spark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,lat,lon\n1,2,3\n2,,\n")
    (tmp_path / "b.gpx").write_bytes(GPX)
    (tmp_path / "c.json").write_text("{")
    df = uploads.read_upload(spark, str(tmp_path))
    assert df.count() == 2 + 4 + 1 and {"id", "lat", "lon", "name", "ele", "geometry", "problem"} <= set(df.columns)
    assert df.where("problem is not null").count() == 1 and df.where("geometry is not null").count() == 1 + 3
    assert {r.id for r in df.where("id is not null").collect()} == {"1", "2"}
