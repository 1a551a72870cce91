"""Spreadsheets, shapefiles, Stata files and delimited text as Spark data sources.

Each source is registered with `register(spark)` and read with spark.read.format(name).load(path): paths are listed by
Spark, a file is one partition, and rows leave the reader in Arrow batches.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_rows(data: bytes, sheet: str | None = None) -> list[list]:
    """The rows of a sheet (the first unless named): text, numbers and booleans; dates stay serials, errors are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(_REL)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")}
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        root = ElementTree.fromstring(z.read("xl/" + target.removeprefix("/xl/")))
    out = []
    for row in root.iter(f"{_NS}row"):
        cells: list = []
        for c in row.iter(f"{_NS}c"):
            at = _place(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind, v = c.get("t"), c.find(f"{_NS}v")
            raw = v.text if v is not None else None
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif raw is None or kind == "e":
                cells[at] = None
            elif kind == "s":
                cells[at] = shared[int(raw)]
            elif kind == "b":
                cells[at] = raw == "1"
            else:
                cells[at] = raw if kind == "str" else float(raw)
        out.append(cells)
    return out


def unique_headers(cells: list) -> list[str]:
    """Header texts; an empty one is named by its place, a repeated one numbered from 2."""
    seen: dict[str, int] = {}
    out = []
    for i, c in enumerate(cells):
        name = str(c).strip() if c is not None and str(c).strip() else f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def xlsx_table(data: bytes, sheet: str | None = None) -> pd.DataFrame:
    """A sheet as a table: the first row that holds anything is the header; every value is text or null."""
    rows = [r for r in xlsx_rows(data, sheet) if any(c is not None and c != "" for c in r)]
    if not rows:
        return pd.DataFrame()
    names = unique_headers(rows[0])
    plain = lambda v: None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return pd.DataFrame([[plain(r[i]) if i < len(r) else None for i in range(len(names))] for r in rows[1:]], columns=names)


def dbf_table(data: bytes) -> pd.DataFrame:
    """A dBase III table: C as text, N and F as numbers, L as booleans, D as text; blanks are null."""
    n, header, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]))
        at += 32
    rows = []
    for k in range(n):
        p = header + k * size
        if data[p : p + 1] == b"*":
            rows.append(None)
            continue
        p, row = p + 1, {}
        for name, kind, width in fields:
            v = data[p : p + width].decode("utf-8", "replace").strip(" \0")
            row[name] = None if not v or set(v) == {"*"} else (float(v) if kind in "NF" else v.upper() in ("T", "Y") if kind == "L" else v)
            p += width
        rows.append(row)
    return pd.DataFrame([r or {} for r in rows], columns=[f[0] for f in fields])


def shp_shapes(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The parts of each record: points, lines or rings of a .shp (M and Z variants keep x and y)."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            out.append([])
        elif kind % 10 == 1:
            out.append([[struct.unpack("<2d", body[4:20])]])
        else:
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            xy = list(zip(flat[::2], flat[1::2]))
            out.append([xy[a:b] for a, b in zip(starts, starts[1:])])
        at += 8 + size
    return out


def signed_area(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]])) / 2


def _inside(p, ring) -> bool:
    x, y, hit = *p, False
    for (a, b), (c, d) in zip(ring, [*ring[1:], *ring[:1]]):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            hit = not hit
    return hit


def polygons(rings) -> list[list]:
    """Rings of a record as polygons [outer, holes...]: clockwise rings are outer, each hole goes to the one around it."""
    outer = [[r] for r in rings if len(r) > 2 and signed_area(r) <= 0]
    for hole in (r for r in rings if len(r) > 2 and signed_area(r) > 0):
        owner = min((o for o in outer if _inside(hole[0], o[0])), key=lambda o: abs(signed_area(o[0])), default=None)
        (owner.append(hole) if owner else outer.append([hole]))
    return outer


def shapefile(rows: list[tuple[str, list]]) -> dict[str, bytes]:
    """Polygons ([outer, holes...] each) with a GEOID column as the bytes of .shp, .shx, .dbf and .prj."""
    shp, shx, at = [], [], 50
    all_points = [p for _, polys in rows for poly in polys for ring in poly for p in ring] or [(0.0, 0.0)]
    box = lambda ps: (min(x for x, _ in ps), min(y for _, y in ps), max(x for x, _ in ps), max(y for _, y in ps))
    for n, (_, polys) in enumerate(rows, 1):
        rings = [(r if (signed_area(r) <= 0) == (k == 0) else r[::-1]) for poly in polys for k, r in enumerate(poly)]
        points = [p for r in rings for p in r]
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        body = struct.pack("<i4d2i", 5, *(box(points) if points else (0, 0, 0, 0)), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        shp.append(struct.pack(">2i", n, len(body) // 2) + body)
        shx.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i4d4d", 1000, 5, *box(all_points), 0, 0, 0, 0)
    width = max([len(g) for g, _ in rows] + [1])
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 65, width + 1) + struct.pack("<11sc4xB15x", b"GEOID", b"C", width) + b"\r" + b"".join(b" " + g.encode().ljust(width) for g, _ in rows) + b"\x1a"
    prj = b'GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983",SPHEROID["GRS_1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["Degree",0.017453292519943295]]'
    return {"shp": head(at) + b"".join(shp), "shx": head(50 + 4 * len(shx)) + b"".join(shx), "dbf": dbf, "prj": prj}


def write_shapefile(rows: list[tuple[str, list]], base: str) -> None:
    """The same as files beside each other; a few thousand areas."""
    for end, content in shapefile(rows).items():
        with open(f"{base}.{end}", "wb") as f:
            f.write(content)


def read_files(spark: SparkSession, path: str, parse, schema: str | None = None) -> DataFrame:
    """Rows of each file under a path (any store that Spark reads), parsed on the executors into a pandas table.

    Without a schema the first file's header is read here and every column is text.
    """
    files = spark.read.format("binaryFile").load(path)
    if schema is None:
        first = parse(files.orderBy("path").first()["content"])
        schema = ", ".join(f"`{c}` string" for c in first.columns)
    return parsed_files(files, parse, schema)


def parsed_files(files: DataFrame, parse, schema: str) -> DataFrame:
    """Rows of files that a table holds (content): parse(bytes) gives each one's pandas table."""
    names = [f.name for f in files.sparkSession.createDataFrame([], schema).schema]

    def parsed(batches):
        for batch in batches:
            for content in batch["content"]:
                yield parse(bytes(content)).reindex(columns=names)

    return files.select("content").mapInPandas(parsed, schema)


def csv_rows(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Rows of CSV lines: quoted cells, doubled quotes, CRLF; blank lines are none."""
    some = lines.where(F.trim(F.col(value)) != "").select(F.from_csv(F.regexp_replace(value, "\r$", ""), schema, {"quote": '"', "escape": '"'}).alias("_r"))
    return some.select("_r.*")


def summary_level(lines: DataFrame, level: str, cells: dict[str, tuple[int, str]], value: str = "value") -> DataFrame:
    """(geoid, cells) of pipe-delimited lines whose geography is of a summary level such as 1400000US: name -> (place, type)."""
    parts = F.split(value, r"\|")
    geo_id = F.element_at(parts, 1)
    return lines.where(geo_id.startswith(level)).select(F.substring(geo_id, F.instr(geo_id, F.lit("US")) + 2, F.length(geo_id)).alias("geoid"), *(F.try_element_at(parts, F.lit(i)).try_cast(kind).alias(n) for n, (i, kind) in cells.items()))


def sequence_estimates(estimates: DataFrame, geography: DataFrame, cells: dict[str, int], value: str = "value") -> DataFrame:
    """(geoid, cells) of estimate lines (state, record, then cells by place) by a geography (state, record, geoid)."""
    parts = F.split(value, ",")
    rows = estimates.select(F.element_at(parts, 1).alias("state"), F.element_at(parts, 2).cast("long").alias("record"), *(F.try_element_at(parts, F.lit(i)).try_cast("double").alias(n) for n, i in cells.items()))
    return rows.join(geography, ["state", "record"]).select("geoid", *cells)


def padded_values(rows: DataFrame, geoid: str, value: str, digits: int = 11) -> DataFrame:
    """(geoid, value) of answers in texts: the identifier with leading zeros, rows without one or without a number dropped."""
    from geoloom.functions.records import padded

    return rows.select(padded(geoid, digits).alias("geoid"), F.trim(value).try_cast("double").alias("value")).where("geoid is not null and value is not null")


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    return read_files(spark, path, lambda data: xlsx_table(bytes(data), sheet), schema)


def read_dbf(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_files(spark, path, lambda data: dbf_table(bytes(data)), schema)


def read_stata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_files(spark, path, lambda data: pd.read_stata(io.BytesIO(bytes(data)), convert_categoricals=False), schema)


def read_shapefile(spark: SparkSession, base: str) -> DataFrame:
    """(record, polygons) of base.shp."""
    kind = "record int, polygons array<array<array<struct<x:double,y:double>>>>"

    def parse(data):
        shapes = [polygons(s) for s in shp_shapes(bytes(data))]
        points = [[[[{"x": x, "y": y} for x, y in ring] for ring in poly] for poly in polys] for polys in shapes]
        return pd.DataFrame({"record": range(len(points)), "polygons": points})

    return read_files(spark, f"{base}.shp", parse, kind)


def read_table8(rows: DataFrame) -> DataFrame:
    """City rows of a yearly crime table (line, c0 state or blank, c1 city, c2 ...): the state filled down, - is 0, blank null."""
    from pyspark.sql import Window as W

    state = F.last(F.nullif(F.trim("c0"), F.lit("")), ignorenulls=True).over(W.partitionBy("year").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    counts = [c for c in rows.columns if c.startswith("c") and c not in ("c0", "c1")]
    value = lambda c: F.when(F.trim(c) == "-", 0).otherwise(F.regexp_replace(c, ",", "").try_cast("int"))
    return rows.withColumn("state", state).where(F.trim("c1") != "").select("year", "state", F.trim("c1").alias("city"), *(value(c).alias(c) for c in counts))



