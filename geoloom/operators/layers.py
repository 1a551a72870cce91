"""Area layers: feature lines, chunk pruning, typed projection and derived measures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions import geo

#: Chunks that a scan may read without a state or a view.
MOST_CHUNKS = 120


def features(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Feature lines (one JSON object in each, blank ones skipped, CRLF allowed) as typed columns."""
    some = lines.where(F.trim(F.col(value)) != "")
    parsed = F.from_json(F.regexp_replace(value, "\r$", ""), schema)
    return some.withColumn("_f", parsed).select(*(c for c in lines.columns if c != value), "_f.*")


def index(layer: DataFrame, chunk: str) -> DataFrame:
    """The box and number of areas of each chunk."""
    return layer.groupBy(F.col(chunk).alias("chunk")).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.count(F.lit(1)).alias("areas"))


def pruned(layer: DataFrame, state: str | None = None, view: tuple | None = None, chunks: int | None = None) -> DataFrame:
    """Areas of a state and view (west, south, east, north; borders included).

    Both conditions are plain comparisons on stored columns, so a scan skips chunks by them. Without either, a layer of
    more than MOST_CHUNKS chunks is refused.
    """
    if state is None and view is None and (chunks or 0) > MOST_CHUNKS:
        raise ValueError(f"{chunks} chunks: give a state or a view")
    if state:
        layer = layer.where(F.col("geoid").startswith(state))
    if view:
        west, south, east, north = view
        layer = layer.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    return layer


def numbered(layer: DataFrame, chunk: str, order: str) -> DataFrame:
    """The layer with each line's number within its chunk: chunks may be read by many tasks and still be put in order."""
    return layer.withColumn("line", F.row_number().over(W.partitionBy(chunk).orderBy(order)).cast("long"))


def sample(layer: DataFrame, chunk: str, order: str, chunks: int = 3, lines: int = 400) -> DataFrame:
    """The first lines of the first chunks, to infer a schema from."""
    first = layer.select(chunk).distinct().orderBy(chunk).limit(chunks)
    rank = F.row_number().over(W.partitionBy(chunk).orderBy(order))
    return layer.join(first, chunk, "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= lines).drop("_rank")


def without(layer: DataFrame, name: Column, excluded: list[str], shape: Column) -> tuple[DataFrame, DataFrame]:
    """(features of layers that are not excluded, of a shape that is wanted; one row with how many were skipped)."""
    ok = F.coalesce(~name.isin(*excluded) & shape, F.lit(False))
    return layer.where(ok), layer.agg(F.count_if(~ok).alias("skipped"))


def kinds(df: DataFrame) -> dict[str, str]:
    """numeric or string for each column."""
    return {n: "numeric" if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal") else "string" for n, k in df.dtypes}


def legal_names(names: list[str], most: int = 28) -> dict[str, str]:
    """Legal and unique column names: sanitized, at most so long, repeats numbered from 2."""
    out, taken = {}, set()
    for name in names:
        base = re.sub(r"[^a-z0-9_]+", "_", name.lower()).strip("_") or "v"
        base = ("v" + base if base[0].isdigit() else base)[:most]
        new, n = base, 2
        while new in taken:
            new = f"{base[: most - len(str(n)) - 1]}_{n}"
            n += 1
        taken.add(new)
        out[name] = new
    return out


def rows(layer: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """The columns in order under their measure names; lon and lat to 5 places."""
    return layer.select(*(F.round(c, 5).alias(c) if c in ("lon", "lat") else F.col(c).alias(names.get(c, c)) for c in columns))


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole to 2 places; null if the whole is not above or the part is below 0."""
    return F.when((whole > 0) & (part >= 0), F.round(100 * part / whole, 2))


def measured(layer: DataFrame, measures: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Declared shares: name -> (columns of the part, columns of the whole)."""
    total = lambda cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
    return layer.withColumns({n: share(total(a) * 1.0, total(b)) for n, (a, b) in measures.items()})


def in_view(layer: DataFrame, west, south, east, north) -> DataFrame:
    return layer.where(geo.in_box("lat", "lon", west, south, east, north))


def fair_share(rows: DataFrame, pack: str, order: str, most: int) -> DataFrame:
    """At most `most` rows, dealt round-robin over the packs: each one's first, each one's second, and so on, as `turn`.

    A pack with fewer rows leaves its share to the others. A pack can give no more than `most` rows, so it is first cut to
    its first ones, by partial top-k; ties of a turn go by the pack's name.
    """
    turn = F.row_number().over(W.partitionBy(pack).orderBy(order)).cast("long")
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", pack).limit(most)


#: Bits of each coordinate in a place along the curve.
_CURVE_BITS = 16


def curve(lon: str = "lon", lat: str = "lat") -> Column:
    """A place along a Z-shaped curve through the globe: places near each other are mostly near along it; null without one."""

    def spread(c: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return c

    most = (1 << _CURVE_BITS) - 1
    scaled = lambda c, low, span: F.least(F.lit(most), F.greatest(F.lit(0), F.floor((F.col(c) - low) / span * (most + 1)))).cast("long")
    return spread(scaled(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(scaled(lat, -90.0, 180.0)), 1))


def write_clustered(layer: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Write a layer (lon, lat) so that a view reads few files, with an index of their boxes; the index.

    Rows are dealt by ranges of their place along the curve, one file a range (`files`, or as many as shuffle partitions),
    and sorted by it within, so row groups are clustered as well. Rows without a place are in the first range. The index
    (file, areas, west, south, east, north) lies below the layer, where scans of the layer do not look.
    """
    spark = layer.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = layer.withColumn("_curve", curve())
    # of rows at one place on the curve a range may hold a hot one: the second key lets it be dealt to several files
    dealt = placed.repartitionByRange(n, F.col("_curve").asc_nulls_first(), F.xxhash64(*layer.columns)).sortWithinPartitions("_curve")
    dealt.drop("_curve").write.parquet(path)
    boxes = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("areas"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    boxes.coalesce(1).write.parquet(f"{path}/_boxes")
    return spark.read.parquet(f"{path}/_boxes")


def read_view(spark, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """The rows of a clustered layer in a view, borders included, from the files whose boxes meet it.

    A view whose west is beyond its east crosses the date line. The driver gets the names of those files alone.
    """
    boxes = spark.read.parquet(f"{path}/_boxes")
    across = west > east
    meets = (F.col("south") <= north) & (F.col("north") >= south)
    meets &= ((F.col("east") >= west) | (F.col("west") <= east)) if across else ((F.col("east") >= west) & (F.col("west") <= east))
    found = sorted(r.file for r in boxes.where(meets).select("file").collect())
    whole = spark.read.parquet(path)
    some = spark.read.schema(whole.schema).parquet(*found) if found else whole.limit(0)
    lon = (F.col("lon") >= west) | (F.col("lon") <= east) if across else F.col("lon").between(west, east)
    return some.where(lon & F.col("lat").between(south, north))
