"""Layers written along a curve: views read few files and lose no row."""

import random

from pyspark.sql import functions as F

from geoloom.operators import layers


def test_views_read_few_files(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, r.uniform(-180, 180), r.uniform(-90, 90)) for k in range(4000)] + [(k, 179.9, 10.0) for k in range(4000, 4100)] + [(5000, None, 1.0), (5001, 180.0, 90.0), (5002, -180.0, -90.0)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double")
    index = layers.write_clustered(df, f"{tmp_path}/layer", 64)
    assert index.agg(F.sum("areas")).first()[0] == len(rows) and 40 <= index.count() <= 64
    assert spark.read.parquet(f"{tmp_path}/layer").count() == len(rows)
    for west, south, east, north in ((-10, -10, 10, 10), (100, 30, 120, 45), (170, -5, -170, 20), (-180, -90, 180, 90), (179.9, 10, 179.9, 10), (50, 50, 50.0001, 50.0001)):
        got = layers.read_view(spark, f"{tmp_path}/layer", west, south, east, north)
        want = {k for k, x, y in rows if x is not None and south <= y <= north and (west <= x <= east if west <= east else x >= west or x <= east)}
        assert {x.id for x in got.select("id").collect()} == want
        if east - west < 30:
            assert len(got.inputFiles()) <= 16
    assert layers.read_view(spark, f"{tmp_path}/layer", 0, 0, 1, 1).columns == df.columns


def test_places_on_the_curve(spark):
    """Quarters of the globe are whole stretches of the curve, and so are theirs."""
    df = spark.range(64).select(((F.col("id") % 8) * 45.0 - 180 + 1).alias("lon"), (F.floor(F.col("id") / 8) * 22.5 - 90 + 1).alias("lat"))
    places = [(int((x.lon + 180) // 45), int((x.lat + 90) // 22.5), x.z) for x in df.select("lon", "lat", layers.curve().alias("z")).collect()]
    order = [(c, r) for c, r, _ in sorted(places, key=lambda p: p[2])]
    for size in (4, 16):
        for k in range(0, 64, size):
            c, r = zip(*order[k : k + size])
            assert max(c) - min(c) + 1 == max(r) - min(r) + 1 == int(size**0.5)
