"""Vector tiles: the binary layers of map tiles as rows of features with properties and coordinates.

A tile is decoded in a task: fields of its messages by their numbers, tags by the layer's keys and values, and geometry
from commands with zigzag steps, in the units of the layer's extent, which the tile's place turns into degrees. What is cut
off or does not follow the format raises an error; `features` gives one row that says so and goes on.
"""

from __future__ import annotations

import gzip
import json
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Kinds of geometry, and the commands of one.
KINDS = {1: "point", 2: "line", 3: "polygon"}
MOVE, LINE, CLOSE = 1, 2, 7

ROWS = "z int, x long, y long, layer string, place int, id long, kind string, properties map<string,string>, parts array<array<struct<lon:double,lat:double>>>, problem string"


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut off")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields: a varint, or the bytes of what has a length or a fixed width."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
            continue
        if kind == 2:
            size, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"no such wire type: {kind}")
        if at + size > len(data):
            raise ValueError("a field is cut off")
        yield key >> 3, data[at : at + size]
        at += size


def _numbers(data: memoryview) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def _signed(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _value(data: memoryview):
    out = None
    for number, v in _fields(data):
        if number == 1:
            out = bytes(v).decode("utf-8", "replace")
        elif number == 2:
            out = struct.unpack("<f", v)[0]
        elif number == 3:
            out = struct.unpack("<d", v)[0]
        elif number == 4:
            out = v - (1 << 64) if v >= 1 << 63 else v
        elif number == 5:
            out = v
        elif number == 6:
            out = _signed(v)
        elif number == 7:
            out = bool(v)
    return out


def _parts(commands: list[int], kind: int) -> list[list[tuple[int, int]]]:
    """The points, lines or closed rings of a geometry, in the layer's units."""
    parts: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command == CLOSE:
            if not parts or not parts[-1]:
                raise ValueError("nothing to close")
            parts[-1].append(parts[-1][0])
            continue
        if command not in (MOVE, LINE) or at + 2 * count > len(commands):
            raise ValueError("a geometry is cut off")
        for k in range(count):
            x, y = x + _signed(commands[at]), y + _signed(commands[at + 1])
            at += 2
            if command == MOVE:
                parts.append([(x, y)])
            elif not parts:
                raise ValueError("a line without a start")
            else:
                parts[-1].append((x, y))
    return [p for p in parts if kind == 1 or len(p) > 1]


def place(z: int, x: int, y: int, extent: int, px: float, py: float) -> tuple[float, float]:
    """Longitude and latitude of a place in a tile."""
    n = 1 << z
    return (x + px / extent) / n * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + py / extent) / n))))


def decoded(data: bytes, z: int, x: int, y: int) -> Iterator[tuple]:
    """(layer, place in it, id, kind, properties, parts) of a tile's features; a gzipped tile is opened first."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for number, layer in _fields(memoryview(data)):
        if number != 3:
            continue
        name, extent, keys, values, features = "", 4096, [], [], []
        for n, v in _fields(layer):
            if n == 1:
                name = bytes(v).decode("utf-8", "replace")
            elif n == 2:
                features.append(v)
            elif n == 3:
                keys.append(bytes(v).decode("utf-8", "replace"))
            elif n == 4:
                values.append(_value(v))
            elif n == 5:
                extent = v
        for k, feature in enumerate(features):
            ident, kind, tags, commands = None, 0, [], []
            for n, v in _fields(feature):
                if n == 1:
                    ident = v
                elif n == 2:
                    tags = _numbers(v)
                elif n == 3:
                    kind = v
                elif n == 4:
                    commands = _numbers(v)
            if len(tags) % 2 or any(t >= len(keys) for t in tags[::2]) or any(t >= len(values) for t in tags[1::2]):
                raise ValueError("a tag names no key or value")
            props = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}
            parts = [[place(z, x, y, extent, *p) for p in part] for part in _parts(commands, kind)]
            yield name, k, ident, KINDS.get(kind), props, parts


def _text(v) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v)


def features(tiles: DataFrame) -> DataFrame:
    """Features of tiles (z, x, y, content): their place, layer, id, kind, properties as texts, and parts in degrees.

    A tile that is cut off gives what comes before the fault, and one row with the problem; null contents give nothing.
    """
    columns = ["z", "x", "y", "layer", "place", "id", "kind", "properties", "parts", "problem"]

    def read(batches):
        for batch in batches:
            for z, x, y, content in zip(batch["z"], batch["x"], batch["y"], batch["content"]):
                rows = []
                if content is None:
                    continue
                try:
                    for layer, k, ident, kind, props, parts in decoded(bytes(content), int(z), int(x), int(y)):
                        ident = ident - (1 << 64) if ident is not None and ident >= 1 << 63 else ident
                        rows.append((z, x, y, layer, k, ident, kind, {a: _text(b) for a, b in props.items()}, [[{"lon": p, "lat": q} for p, q in part] for part in parts], None))
                except (ValueError, OSError, struct.error, EOFError) as e:
                    rows.append((z, x, y, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=columns).astype({"place": "Int64", "id": "Int64"})

    return tiles.select("z", "x", "y", "content").mapInPandas(read, ROWS)
