"""Feed formats as typed rows: JSON shapes, element sets, KML, byte inventories, news and archives."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import geo

#: Bytes that an archive may unpack to, and how deep archives may nest.
MOST_BYTES, MOST_DEPTH = 512 << 20, 3


def _json(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    return df.select(F.from_json(value, schema).alias("j"))


def earthquakes(df: DataFrame, least: float = 2.5) -> DataFrame:
    """Quakes of feature collections (one in each row), magnitude `least` and up; a collection with a bad or repeated one is refused."""
    shape = "features array<struct<id:string,properties:struct<mag:double,place:string,time:bigint>,geometry:struct<coordinates:array<double>>>>"
    j = _json(df, shape).withColumn("n", F.monotonically_increasing_id())
    f = j.select("n", F.explode("j.features").alias("f"))
    at = lambda i: F.try_element_at("f.geometry.coordinates", F.lit(i))
    rows = f.select("n", "f.id", "f.properties.mag", "f.properties.place", "f.properties.time", at(1).alias("lon"), at(2).alias("lat"), at(3).alias("depth"))
    bad = F.col("id").isNull() | F.col("mag").isNull() | F.col("time").isNull() | ~geo.valid_point("lat", "lon")
    refused = rows.groupBy("n").agg(F.max(F.coalesce(bad, F.lit(True))).alias("bad"), F.count(F.lit(1)).alias("a"), F.count_distinct("id").alias("b")).where("bad or a != b").select("n")
    return rows.join(refused, "n", "left_anti").where(F.col("mag") >= least).drop("n")


#: Columns that a fire table must have.
FIRE_COLUMNS = ("latitude", "longitude", "acq_date", "acq_time", "confidence", "frp")


def _fire_lines(value: str) -> Column:
    """The lines of an answer from the first one that holds anything."""
    return F.split(F.regexp_replace(value, r"^\s+", ""), r"\r?\n")


def _fire_header(value: str) -> Column:
    return F.transform(F.split(F.lower(F.element_at(_fire_lines(value), 1)), ","), F.trim)


def is_fire_csv(value: str = "value") -> Column:
    """Whether an answer is a fire table and no page or error text: its first line names all columns that are needed."""
    text = F.regexp_replace(value, r"^\s+", "")
    header = _fire_header(value)
    return F.coalesce((text != "") & ~text.startswith("<") & F.size(F.array_intersect(header, F.array(*map(F.lit, FIRE_COLUMNS)))).eqNullSafe(len(FIRE_COLUMNS)), F.lit(False))


def fire_rows(df: DataFrame, value: str = "value") -> DataFrame:
    """Detections of fire tables (one in each row of df, other columns are kept): columns by name, in either sensor's format.

    An answer that is no table gives none; a line with too few cells or without a place is skipped, others stand.
    """
    kept = [c for c in df.columns if c != value]
    tables = df.where(is_fire_csv(value)).select(*kept, _fire_header(value).alias("_h"), _fire_lines(value).alias("_l"))
    lines = tables.select(*kept, "_h", F.explode(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0)))).alias("_line")).withColumn("_p", F.split(F.trim("_line"), ","))
    at = lambda *names: F.coalesce(*(F.when(F.array_contains("_h", n), F.try_element_at("_p", F.nullif(F.array_position("_h", F.lit(n)), F.lit(0)).cast("int"))) for n in names))
    number = lambda *names: F.coalesce(F.trim(at(*names)).try_cast("double"), F.lit(0.0))
    place = lambda n: F.trim(at(n)).try_cast("double")
    rows = lines.where((F.trim("_line") != "") & (F.size("_p") >= F.size("_h"))).select(
        *kept, place("latitude").alias("lat"), place("longitude").alias("lon"), number("frp").alias("frp"), F.trim(at("confidence")).alias("confidence"), number("bright_ti4", "brightness").alias("brightness"), number("bright_ti5", "bright_t31").alias("brightness_2"),
        F.trim(at("daynight")).alias("daynight"), F.trim(at("acq_date")).alias("acq_date"), F.trim(at("acq_time")).alias("acq_time"), F.trim(at("satellite")).alias("satellite"), F.trim(at("instrument")).alias("instrument"),
    )
    return rows.where(geo.valid_point("lat", "lon"))


def union_sources(sources: dict[str, DataFrame], time: str, now_ms: int | None = None, keep_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of all sources with their name and order, without those too old; rows and newest time of each source)."""
    every = None
    for n, (name, df) in enumerate(sources.items()):
        one = df.withColumns({"source": F.lit(name), "source_order": F.lit(n)})
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    if keep_ms is not None:
        every = every.where(F.lit(now_ms) - F.col(time) <= keep_ms)
    asked = df.sparkSession.createDataFrame([(k,) for k in sources], "source string")
    stats = every.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("newest"))
    return every, asked.join(stats, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def delta_ring(steps) -> Column:
    """A packed ring (x, y, dx, dy, dx, dy, ...) as an array of points (x, y)."""
    s = F.col(steps) if isinstance(steps, str) else steps
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / 2).cast("int") - 1), lambda i: F.struct(F.element_at(s, 2 * i + 1).alias("x"), F.element_at(s, 2 * i + 2).alias("y")))
    first = F.slice(pairs, 1, 1)
    add = lambda out, p: F.concat(out, F.array(F.struct((F.element_at(out, -1)["x"] + p["x"]).alias("x"), (F.element_at(out, -1)["y"] + p["y"]).alias("y"))))
    return F.when(F.size(s) >= 2, F.aggregate(F.slice(pairs, 2, F.size(pairs)), first, add))


def perimeters(df: DataFrame) -> DataFrame:
    """Fire perimeters of feature collections; a feature without id or rings is skipped by itself."""
    shape = "features array<struct<properties:struct<id:string,name:string,acres:double>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    f = _json(df, shape).select(F.explode("j.features").alias("f"))
    return f.where("f.properties.id is not null and size(f.geometry.coordinates) > 0").select("f.properties.*", F.col("f.geometry.coordinates").alias("rings"))


def state_vectors(df: DataFrame) -> DataFrame:
    """Aircraft of {"time", "states": [[...], ...]}: positions in an array, metres and metres a second; rows without a place go."""
    rows = df.select(F.from_json("value", "time bigint, states array<array<string>>").alias("j")).select("j.time", F.explode("j.states").alias("s"))
    at = lambda i, kind: F.nullif(F.try_element_at("s", F.lit(i + 1)), F.lit("")).try_cast(kind)
    out = rows.select(
        at(0, "string").alias("id"), F.nullif(F.trim(at(1, "string")), F.lit("")).alias("callsign"), (at(3, "bigint") * 1000).alias("position_ms"), at(5, "double").alias("lon"), at(6, "double").alias("lat"),
        at(7, "double").alias("altitude_m"), at(8, "boolean").alias("on_ground"), at(9, "double").alias("speed_mps"), at(10, "double").alias("course"), at(11, "double").alias("climb_mps"),
    )
    return out.where(F.col("id").isNotNull() & geo.valid_point("lat", "lon"))


def readsb(df: DataFrame) -> DataFrame:
    """Aircraft of {"now", "aircraft": [...]}: feet, knots and feet a minute as metres; "ground" is no altitude."""
    shape = "now double, aircraft array<struct<hex:string,flight:string,lat:double,lon:double,alt_baro:string,gs:double,track:double,baro_rate:double,seen_pos:double>>"
    a = _json(df, shape).select("j.now", F.inline("j.aircraft"))
    return a.where(geo.valid_point("lat", "lon")).select(
        F.lower(F.trim("hex")).alias("id"), F.nullif(F.trim("flight"), F.lit("")).alias("callsign"), "lat", "lon", (F.col("alt_baro").try_cast("double") * geo.FOOT).alias("altitude_m"),
        (F.col("alt_baro") == "ground").alias("on_ground"), (F.col("gs") * geo.KNOT).alias("speed_mps"), F.col("track").alias("course"), (F.col("baro_rate") * geo.FOOT_A_MINUTE).alias("climb_mps"),
        F.round((F.col("now") - F.coalesce("seen_pos", F.lit(0.0))) * 1000).cast("long").alias("position_ms"),
    )


def vessels(df: DataFrame, signed: bool = False) -> DataFrame:
    """Vessels (mmsi, lat, lon, name, type, speed, course, heading, as texts): blanks and sentinel values are null.

    signed: the feed writes what was measured with a sign, so that a reading of +102.3 is no sentinel.
    """
    measured = lambda c: F.trim(c).rlike("^[+-]") if signed else F.lit(False)
    number = lambda c, none: F.when(measured(c) | (F.nullif(F.trim(c), F.lit("")).try_cast("double") != none), F.trim(c).try_cast("double"))
    return df.select("mmsi", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), F.nullif(F.trim("name"), F.lit("")).alias("name"), F.col("type"),
                     number("speed", 102.3).alias("speed"), number("course", 360.0).alias("course"), number("heading", 511.0).alias("heading")).where(F.col("mmsi").isNotNull() & geo.valid_point("lat", "lon"))


def stations(info: DataFrame, status: DataFrame) -> DataFrame:
    """Bike stations with what is free: {"data": {"stations": [...]}} or {"stations": [...]}; a name may be a list of texts."""
    a = "stations array<struct<station_id:string,name:string,lat:double,lon:double,capacity:int>>"
    b = "stations array<struct<station_id:string,num_bikes_available:int,num_docks_available:int>>"
    both = lambda df, s: df.select(F.inline(F.coalesce(F.from_json("value", f"data struct<{s.replace(' ', ':', 1)}>")["data"]["stations"], F.from_json("value", s)["stations"])))
    i = both(info, a).withColumn("name", F.coalesce(F.get_json_object("name", "$[0].text"), "name"))
    return i.where(F.col("station_id").isNotNull() & geo.valid_point("lat", "lon")).join(both(status, b), "station_id", "left")


#: Letters that stand for 10 to 33 in a catalog number (I and O are left out).
_ALPHA5 = "ABCDEFGHJKLMNPQRSTUVWXYZ"


def element_sets(lines: DataFrame) -> DataFrame:
    """(name, catalog, line1, line2) of three-line sets; lines: (file, n, line). Both numbers must agree.

    Numbers above 339,999, which five columns cannot hold, are read where six to nine digits stand in place of the five
    columns: a set of five columns has a letter or a blank after them.
    """
    w = W.partitionBy("file").orderBy("n")
    x = lines.select("file", "n", F.rtrim("line").alias("line"), F.lead(F.rtrim("line"), 1).over(w).alias("line1"), F.lead(F.rtrim("line"), 2).over(w).alias("line2"))
    code = F.trim(F.substring("line1", 3, 5))
    first = F.expr(f"instr('{_ALPHA5}', substring(trim(substring(line1, 3, 5)), 1, 1))")
    number = F.coalesce(code.try_cast("long"), F.when(first > 0, (first + 9) * 10000 + F.substring(code, 2, 4).try_cast("long")))
    wide, other = F.regexp_extract("line1", "^1 ([0-9]{6,9})(?![0-9])", 1), F.regexp_extract("line2", "^2 ([0-9]{6,9})(?![0-9])", 1)
    number = F.coalesce(F.nullif(wide, F.lit("")).try_cast("long"), number)
    same = (F.substring("line1", 3, 5) == F.substring("line2", 3, 5)) & (wide == other)
    return x.where(F.col("line1").startswith("1 ") & F.col("line2").startswith("2 ") & same & ~F.col("line").rlike("^[12] ")).select(F.trim("line").alias("name"), number.alias("catalog"), "line1", "line2")


def byte_inventory(lines: DataFrame, size: Column) -> DataFrame:
    """(message, first, last, variable, level) of an index of "n:offset:date:variable:level:..." lines (file, line)."""
    part = lambda i: F.try_element_at(F.split("line", ":"), F.lit(i))
    x = lines.select("file", part(1).try_cast("int").alias("message"), part(2).try_cast("long").alias("first"), part(4).alias("variable"), part(5).alias("level"), size.alias("size")).where("first is not null")
    return x.withColumn("last", F.coalesce(F.lead("first").over(W.partitionBy("file").orderBy("first")), "size") - 1).drop("size")


def json_inventory(lines: DataFrame) -> DataFrame:
    """The same of JSON lines that carry offset and length."""
    j = lines.select("file", F.from_json("line", "param string, levelist string, _offset long, _length long").alias("j"))
    return j.select("file", F.col("j._offset").alias("first"), (F.col("j._offset") + F.col("j._length") - 1).alias("last"), F.col("j.param").alias("variable"), F.col("j.levelist").alias("level"))


#: Densities of smoke styles.
_SMOKE = {"smoke_light": 5, "smoke_medium": 16, "smoke_heavy": 27}


def smoke(df: DataFrame, most: int | None = 400) -> DataFrame:
    """(density, ring) of the placemarks of a KML text in each row; those without four points are skipped. most: rows, None all."""
    marks = df.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark.*?</Placemark>"), 0)).alias("n", "mark"))
    style = F.lower(F.regexp_extract("mark", r"<styleUrl>#?([^<]*)</styleUrl>", 1))
    density = F.coalesce(*(F.when(style.contains(k), v) for k, v in _SMOKE.items()))
    text = F.trim(F.regexp_extract("mark", r"(?s)<coordinates>(.*?)</coordinates>", 1))
    pair = lambda p, i: F.try_element_at(F.split(p, ","), F.lit(i)).try_cast("double")
    ring = F.filter(F.transform(F.split(text, r"\s+"), lambda p: F.struct(pair(p, 1).alias("x"), pair(p, 2).alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    rows = marks.select("n", density.alias("density"), ring.alias("ring")).where("density is not null and size(ring) >= 4")
    return (rows if most is None else rows.orderBy("n").limit(most)).select("density", "ring")


def articles(df: DataFrame, most: int | None = 5) -> DataFrame:
    """(title, host, link) of RSS texts, the first of each title and host, at most so many (None: all)."""
    from geoloom.functions.text import clean, decoded

    items = df.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<item.*?</item>"), 0)).alias("n", "item"))
    tag = lambda k: clean(decoded(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{k}[^>]*>(.*?)</{k}>", 1), r"<!\[CDATA\[|\]\]>", "")), 300)
    x = items.select("n", tag("title").alias("title"), tag("link").alias("link")).withColumn("host", F.regexp_replace(F.try_parse_url("link", F.lit("HOST")), r"^www\.", "")).where("title is not null and host is not null")
    first = x.groupBy(F.lower("title").alias("_t"), "host").agg(F.min(F.struct("n", "title", "link")).alias("f"))
    rows = first.select("f.n", "f.title", "host", "f.link")
    return (rows if most is None else rows.orderBy("n").limit(most)).select("title", "host", "link")


def closed_pack(df: DataFrame, most_points: int | None = 50_000) -> DataFrame:
    """Features of a strict pack: every id there and unique, every ring closed, at most so many points; else an error."""
    shape = "features array<struct<id:string,geometry:struct<coordinates:array<array<array<double>>>>>>"
    f = _json(df, shape).select(F.explode("j.features").alias("f")).select("f.id", F.col("f.geometry.coordinates").alias("rings"))
    closed = F.forall("rings", lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)))
    points = F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r))
    s = f.agg(F.bool_and(F.col("id").isNotNull() & closed).alias("ok"), (F.count(F.lit(1)) == F.count_distinct("id")).alias("once"), F.sum(points).alias("points")).first()
    if not (s["ok"] and s["once"] and (most_points is None or s["points"] <= most_points)):
        raise ValueError("the pack is not valid")
    return f


def first_readable(spark: SparkSession, paths: list[str], kind: str = "text") -> tuple[str, DataFrame] | None:
    """The first of some paths that can be read (text unless another format is named) and is not empty."""
    for p in paths:
        try:
            df = spark.read.format(kind).load(p)
            if not df.isEmpty():
                return p, df
        except Exception:  # noqa: BLE001, S112  a path that is missing raises one of several kinds
            continue
    return None


def offset_pages(spark: SparkSession, fetch, pages: int, size: int, schema: str, key: str) -> DataFrame:
    """Rows of pages that tasks fetch by offset (fetch(offset, size) gives a list of dicts), the first of each key."""

    def fetched(batches):
        for batch in batches:
            for offset in batch["id"]:
                rows = fetch(int(offset) * size, size)
                if rows:
                    yield pd.DataFrame(rows)

    return spark.range(pages, numPartitions=max(1, min(pages, 64))).mapInPandas(fetched, schema).dropDuplicates([key])


def unpacked(name: str, data: bytes, depth: int = 0) -> list[tuple[str, bytes]]:
    """(name, bytes) of the files in an archive (.gz .bz2 .xz .zst .zip .tar, nested); KMZ and XLSX stay whole."""
    low = name.lower()
    if depth > MOST_DEPTH:
        raise ValueError(f"{name}: archives nest too deep")

    def bounded(f) -> bytes:
        out = f.read(MOST_BYTES + 1)
        if len(out) > MOST_BYTES:
            raise ValueError(f"{name}: more than {MOST_BYTES} bytes")
        return out

    for end, opened in ((".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open)):
        if low.endswith(end):
            with opened(io.BytesIO(data)) as f:
                return unpacked(name[: -len(end)], bounded(f), depth + 1)
    if low.endswith(".zst"):
        import zstandard

        return unpacked(name[:-4], bounded(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data))), depth + 1)
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            files = [i for i in z.infolist() if not i.is_dir()]
            if sum(i.file_size for i in files) > MOST_BYTES:
                raise ValueError(f"{name}: more than {MOST_BYTES} bytes")
            return [x for i in files for x in unpacked(i.filename, z.read(i), depth + 1)]
    if low.endswith((".tar", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return [x for m in t if m.isfile() for x in unpacked(m.name, bounded(t.extractfile(m)), depth + 1)]
    return [(name, data)]


#: Bytes of content that a task collects before it hands rows on.
TOGETHER_BYTES = 4 << 20


def in_turn(make, fields: list[tuple[str, pa.DataType]]):
    """A function for mapInArrow: the rows, tuples, that make(row as a dict) gives, for one row after the other.

    Of a batch only the row in hand is unpacked to objects, and rows go on by TOGETHER_BYTES of texts and binaries (maps
    count by their entries), so what a task holds does not follow the number of rows in a batch.
    """
    schema = pa.schema(fields)
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], schema=schema)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for r in make({name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}):
                    rows.append(r)
                    held += 100 + sum(len(v) * (1 if isinstance(v, (str, bytes)) else 100) for v in r if isinstance(v, (str, bytes, list)))
                    if held >= TOGETHER_BYTES:
                        yield table(rows)
                        rows, held = [], 0
        if rows:
            yield table(rows)

    return run


def unpack(files: DataFrame) -> DataFrame:
    """(archive, name, content) of the files in archives (path, content), unpacked on the executors."""
    opened = in_turn(lambda r: ((r["path"], n, c) for n, c in unpacked(r["path"].rsplit("/", 1)[-1], r["content"])), [("archive", pa.string()), ("name", pa.string()), ("content", pa.binary())])
    return files.select("path", "content").mapInArrow(opened, "archive string, name string, content binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the files in the archives under a path."""
    return unpack(spark.read.format("binaryFile").load(path))


#: Readers of uploaded files by their endings.
UPLOADS = {"csv": (".csv",), "tsv": (".tsv", ".tab"), "xlsx": (".xlsx",), "geojson": (".geojson", ".json"), "kml": (".kml", ".kmz"), "gpx": (".gpx",), "shapefile": (".shp",), "archive": (".zip", ".tar", ".gz", ".bz2", ".xz", ".zst")}


def upload_kind(name) -> Column:
    """The reader of an uploaded file by its ending, or null."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.coalesce(*(F.when(low.endswith(end), kind) for kind, ends in UPLOADS.items() for end in ends))


def kind_of(name: str) -> str | None:
    """The reader of an uploaded file by its ending."""
    low = name.lower()
    return next((k for k, ends in UPLOADS.items() if low.endswith(ends)), None)
