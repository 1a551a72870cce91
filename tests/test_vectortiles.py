"""Vector tiles written by a plain encoder and read back."""

import gzip
import random
import struct

import pytest

from geoloom.sources import vectortiles as v


def varint(n):
    out = b""
    while True:
        out, n = out + bytes([n & 0x7F | (0x80 if n > 0x7F else 0)]), n >> 7
        if not n:
            return out


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def geometry(parts, kind):
    out, x, y = [], 0, 0

    def step(p):
        nonlocal x, y
        out.extend((zigzag(p[0] - x), zigzag(p[1] - y)))
        x, y = p

    if kind == 1:
        out.append(len(parts) << 3 | v.MOVE)
        for p in parts:
            step(p[0])
    else:
        for part in parts:
            out.append(1 << 3 | v.MOVE)
            step(part[0])
            rest = part[1:-1] if kind == 3 else part[1:]
            out.append(len(rest) << 3 | v.LINE)
            for p in rest:
                step(p)
            if kind == 3:
                out.append(1 << 3 | v.CLOSE)
    return b"".join(map(varint, out))


VALUES = {"s": (field(1, "é".encode()), "é"), "f": (varint(2 << 3 | 5) + struct.pack("<f", 1.5), 1.5), "d": (varint(3 << 3 | 1) + struct.pack("<d", -2.25), -2.25), "i": (field(4, (1 << 64) - 3), -3), "u": (field(5, 7), 7), "z": (field(6, zigzag(-9)), -9), "b": (field(7, 1), True)}


def tile(shapes, extent=4096, name=b"roads"):
    keys = list(VALUES)
    layer = field(15, 2) + field(1, name)
    for k, (kind, parts) in enumerate(shapes):
        tags = b"".join(varint(t) for j in range(k % 8) if j < len(keys) for t in (j, j))
        layer += field(2, field(1, 100 + k) + field(2, tags) + field(3, kind) + field(4, geometry(parts, kind)))
    layer += b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, VALUES[k][0]) for k in keys) + field(5, extent)
    return field(3, layer)


@pytest.mark.parametrize("seed", range(10))
def test_tiles_read_back(seed):
    r = random.Random(seed)
    p = lambda: (r.randint(-80, 4200), r.randint(-80, 4200))
    shapes = []
    for _ in range(9):
        kind = r.choice([1, 2, 3])
        parts = [[p()] if kind == 1 else [p() for _ in range(r.randint(2, 9))] for _ in range(r.randint(1, 3))]
        shapes.append((kind, [[*part, *[p()], part[0]] for part in parts] if kind == 3 else parts))
    extent = r.choice([256, 4096])
    data = tile(shapes, extent)
    for raw in (data, gzip.compress(data)):
        got = list(v.decoded(raw, 14, 4500, 6900))
        assert [(g[0], g[1], g[2], g[3]) for g in got] == [("roads", k, 100 + k, v.KINDS[kind]) for k, (kind, _) in enumerate(shapes)]
        for k, g in enumerate(got):
            assert g[4] == {x: VALUES[x][1] for x in list(VALUES)[: k % 8]}
            assert g[5] == [[v.place(14, 4500, 6900, extent, *q) for q in part] for part in shapes[k][1]]


def test_places():
    assert v.place(0, 0, 0, 4096, 2048, 2048) == (0.0, 0.0)
    lon, lat = v.place(1, 0, 0, 4096, 0, 0)
    assert lon == -180 and abs(lat - 85.0511287798) < 1e-9


def test_tiles_that_are_cut_off(spark):
    data = tile([(2, [[(0, 0), (5, 5)]]), (1, [[(1, 1)]])])
    for n in range(1, len(data)):
        with pytest.raises((ValueError, struct.error)):
            list(v.decoded(data[:n], 3, 1, 1))
    rows = [(3, 1, 1, data), (3, 1, 2, data[:-3]), (3, 1, 3, None), (3, 1, 4, b""), (3, 1, 5, gzip.compress(data)[:-9])]
    got = v.features(spark.createDataFrame(rows, "z int, x long, y long, content binary")).collect()
    assert [(r.y, r.id, r.kind, bool(r.problem)) for r in sorted(got, key=lambda r: (r.y, r.place or 0))] == [(1, 100, "line", False), (1, 101, "point", False), (2, None, None, True), (5, None, None, True)]
    line = next(r for r in got if r.id == 100)
    assert line.properties == {} and [tuple(p) for p in line.parts[0]] == [v.place(3, 1, 1, 4096, 0, 0), v.place(3, 1, 1, 4096, 5, 5)]
