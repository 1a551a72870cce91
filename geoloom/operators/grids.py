"""Regular fields as long tables (ix, iy, v): longitude wraps, latitude is clamped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo


def resample(grid: DataFrame, nx: int, ny: int, wide: int, high: int) -> DataFrame:
    """(x, y, v) of a field of nx * ny cells at wide * high places, between the four cells around each."""
    spark = grid.sparkSession
    x, y = F.col("id") % wide, F.floor(F.col("id") / wide)
    want = spark.range(wide * high).select(x.alias("x"), y.alias("y"), (x * nx / wide).alias("gx"), F.least(y * ny / high, F.lit(float(ny - 1))).alias("gy"))
    want = want.withColumns({"x0": F.floor("gx").cast("int"), "y0": F.floor("gy").cast("int")})
    want = want.withColumns({"x1": ((F.col("x0") + 1) % nx).cast("int"), "y1": F.least(F.col("y0") + 1, F.lit(ny - 1)).cast("int")})
    for name, i, j in (("v00", "x0", "y0"), ("v10", "x1", "y0"), ("v01", "x0", "y1"), ("v11", "x1", "y1")):
        want = want.join(grid.select(F.col("ix").alias(i), F.col("iy").alias(j), F.col("v").alias(name)), [i, j])
    return want.select("x", "y", geo.bilinear("v00", "v10", "v01", "v11", F.col("gx") - F.col("x0"), F.col("gy") - F.col("y0")).alias("v"))


def converted(fields: DataFrame) -> DataFrame:
    """Kelvin as degrees Celsius and pascal as hectopascal."""
    return fields.withColumns({"celsius": F.col("temperature") - 273.15, "hpa": F.col("pressure") / 100})


def same_geometry(a: DataFrame, b: DataFrame) -> bool:
    """Whether two fields have the same cells."""
    return a.select("ix", "iy").exceptAll(b.select("ix", "iy")).isEmpty() and b.select("ix", "iy").exceptAll(a.select("ix", "iy")).isEmpty()


def sampled(points: DataFrame, grid: DataFrame, nx: int, ny: int) -> DataFrame:
    """points (lat, lon) with v of a global field of nx columns from 180 W and ny rows from the south pole, between its four cells."""
    gx, gy = F.pmod((F.col("lon") + 180) / 360 * nx, F.lit(float(nx))), F.least(F.greatest((F.col("lat") + 90) / 180 * (ny - 1), F.lit(0.0)), F.lit(float(ny - 1)))
    want = points.withColumns({"_gx": gx, "_gy": gy}).withColumns({"_x0": F.floor("_gx").cast("int"), "_y0": F.floor("_gy").cast("int")})
    want = want.withColumns({"_x1": ((F.col("_x0") + 1) % nx).cast("int"), "_y1": F.least(F.col("_y0") + 1, F.lit(ny - 1)).cast("int")})
    for name, i, j in (("_v00", "_x0", "_y0"), ("_v10", "_x1", "_y0"), ("_v01", "_x0", "_y1"), ("_v11", "_x1", "_y1")):
        want = want.join(grid.select(F.col("ix").cast("int").alias(i), F.col("iy").cast("int").alias(j), F.col("v").alias(name)), [i, j], "left")
    v = geo.bilinear("_v00", "_v10", "_v01", "_v11", F.col("_gx") - F.col("_x0"), F.col("_gy") - F.col("_y0"))
    return want.withColumn("v", v).select(*points.columns, "v")


def ellipsoid_heights(points: DataFrame, geoid: DataFrame, nx: int, ny: int, height: str = "height") -> DataFrame:
    """points with their height above the ellipsoid: that above the sea and the geoid's undulation there."""
    return sampled(points, geoid, nx, ny).withColumn("ellipsoid_height", F.col(height) + F.col("v")).drop("v")


def with_companions(main: DataFrame, companions: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """main (ix, iy, v) with the companions that lie on its cells, and the names of those that do not and are left out."""
    out, left_out = main, []
    for name, field in companions.items():
        if same_geometry(main, field):
            out = out.join(field.select("ix", "iy", F.col("v").alias(name)), ["ix", "iy"])
        else:
            left_out.append(name)
    return out, left_out
