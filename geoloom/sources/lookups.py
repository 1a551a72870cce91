"""Lookups and contracts: geocoder answers, embedded page data, storm snapshots, cached enrichment, layer names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import scratch

#: Bounds of a storm snapshot, points of a lookup call and of a request, days that a miss is kept.
MOST_STORMS, MOST_COORDINATES, CALL_POINTS, MOST_POINTS, MISS_MS = 32, 25_000, 64, 2_000, 24 * 3_600_000


LAYER_NAME = r"[a-z0-9][a-z0-9_-]{0,63}"


def is_layer_name(name) -> Column:
    return F.coalesce((F.col(name) if isinstance(name, str) else name).rlike(f"^{LAYER_NAME}$"), F.lit(False))


def layer_table(spark: SparkSession, name: str, database: str = "default") -> DataFrame:
    """A layer by its name (lower-case letters, digits, - and _), which must exist."""
    if not re.fullmatch(LAYER_NAME, name):
        raise ValueError(f"not a layer name: {name!r}")
    table = f"{database}.`{name}`"
    if not spark.catalog.tableExists(table):
        raise ValueError(f"no such layer: {name}")
    return spark.table(table)


def geocoded(df: DataFrame) -> DataFrame:
    """(label, locality, region, country) of reverse-geocoder answers in either of two JSON shapes, one in each row."""
    shape = "results array<struct<formatted_address:string,address_components:array<struct<long_name:string,types:array<string>>>>>, display_name string, address map<string,string>"
    j = df.select(F.from_json("value", shape).alias("j"))
    parts = F.coalesce(F.try_element_at("j.results", F.lit(1))["address_components"], F.array())
    of = lambda kind: F.try_element_at(F.filter(parts, lambda p: F.array_contains(p["types"], kind)), F.lit(1))["long_name"]
    named = lambda *keys: F.coalesce(*(F.try_element_at("j.address", F.lit(k)) for k in keys))
    return j.select(
        F.coalesce(F.try_element_at("j.results", F.lit(1))["formatted_address"], "j.display_name").alias("label"),
        F.coalesce(of("locality"), named("city", "town", "village")).alias("locality"),
        F.coalesce(of("administrative_area_level_1"), named("state")).alias("region"),
        F.coalesce(of("country"), named("country")).alias("country"),
    )


def embedded(df: DataFrame, variable: str) -> DataFrame:
    """The JSON value that pages assign to a variable, as a VARIANT; null where it does not parse."""
    text = F.regexp_extract("value", rf'(?s)\b{re.escape(variable)}\s*=\s*"((?:[^"\\]|\\.)*)"', 1)
    plain = F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return df.select(F.try_parse_json(F.nullif(plain, F.lit(""))).alias("data"))


def storms(df: DataFrame, most: int | None = MOST_STORMS, most_points: int | None = MOST_COORDINATES) -> DataFrame:
    """Storms (id, name, wind, track) of a snapshot; an error if ids repeat or bounds are broken (None: no bound)."""
    shape = "storms array<struct<id:string,name:string,wind:double,track:array<array<double>>>>"
    s = df.select(F.inline(F.from_json("value", shape)["storms"]))
    bad = F.col("id").isNull() | (F.col("wind") < 0) | F.exists("track", lambda p: (F.size(p) < 2) | F.coalesce(~p[0].between(-180, 180) | ~p[1].between(-90, 90), F.lit(True)))
    r = s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.sum(F.size("track")).alias("points")).first()
    if r["n"] != r["ids"] or r["bad"] or (most is not None and r["n"] > most) or (most_points is not None and (r["points"] or 0) > most_points):
        raise ValueError(f"not a valid snapshot: {r.asDict()}")
    return s


def looked_up(points: DataFrame, fetch, key: str = "id", cache: DataFrame | None = None, most: int | None = MOST_POINTS) -> DataFrame:
    """(key, value) of points (key, lat, lon): the cache's values, else fetch([(lat, lon)]) for up to CALL_POINTS at once.

    A call that fails gives nulls for its points; more than `most` points (None: no bound), or only failed calls, are an error.
    """
    if most is not None and points.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points")

    def called(batches):
        for b in batches:
            for i in range(0, len(b), CALL_POINTS):
                part = b.iloc[i : i + CALL_POINTS]
                try:
                    values, ok = list(fetch(list(zip(part["lat"], part["lon"])))), True
                except Exception:  # noqa: BLE001  whatever the upstream raises
                    values, ok = [None] * len(part), False
                yield pd.DataFrame({key: part[key], "value": pd.Series(values, index=part.index, dtype="float64"), "ok": ok})

    kind = dict(points.dtypes)[key]
    asked = points if cache is None else points.join(cache.select(key), key, "left_anti")
    got = asked.select(key, "lat", "lon").mapInPandas(called, f"{key} {kind}, value double, ok boolean")
    got = scratch.written(got)  # each call is made once
    if not got.isEmpty() and got.where("ok").isEmpty():
        raise ValueError("every call failed")
    out = got.select(key, "value")
    return out if cache is None else out.unionByName(points.select(key).join(cache, key).select(key, "value"))


def enriched(df: DataFrame, cache: DataFrame, key: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(df with the cache's columns; the keys to ask for). cache: (key, found, at_ms, ...); a miss holds for a day."""
    fresh = cache.where(F.col("found") | (F.lit(now_ms) - F.col("at_ms") <= MISS_MS))
    values = fresh.where("found").drop("found", "at_ms")
    return df.join(values, key, "left"), df.select(key).distinct().join(fresh.select(key), key, "left_anti")


def admission(state_generation: Column, generation: Column, complete: Column) -> Column:
    """What a catalog does with a snapshot: replace by a newer complete one, keep otherwise."""
    return F.when(complete & (state_generation.isNull() | (generation > state_generation)), "replace").otherwise("keep")
