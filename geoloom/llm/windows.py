"""Windows that repeat across documents, found in two rounds of hash buckets.

A round sends (fingerprint, text id, position) of chosen windows to buckets of fingerprints, packed as
binary columns; a bucket is sorted by itself, and the positions whose fingerprint repeats go back by text id.
A fingerprint is 64 bits of a polynomial over random values and a second polynomial, with other values and another base,
of which 16 bits are sent and the rest choose the bucket. Equal windows always meet; two unequal ones of n are taken for
equal with probability n * n / (2**81 * buckets): for 2e13 windows in 3e6 buckets that is 6e-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

_SEGMENT = 1 << 16
#: The bases of the two polynomials.
_BASES = (6364136223846793005, 2862933555777941757)
#: Bytes of text that one packed chunk covers at most (a longer text is a chunk of its own).
CHUNK_BYTES = 16 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    return x


#: Two fixed random 64-bit values for each byte.
BYTE_VALUES = tuple(_mixed(_mixed(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for k in range(2))


class _Powers:
    held = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

    @classmethod
    def to(cls, n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.held[which][0]) < n:
            base = _BASES[which]
            up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cls.held[which] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return cls.held[which]


def fingerprints(values: np.ndarray, length: int, at: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprints of values[p : p + length] for ascending p in `at`; values are uint64, or bytes."""
    out = np.empty(len(at), np.uint64)
    up, down = _Powers.to(_SEGMENT + length + 1, which)
    edges = np.searchsorted(at, np.arange(0, len(values) + _SEGMENT, _SEGMENT))
    for k in np.flatnonzero(np.diff(edges)):
        lo, hi, i = edges[k], edges[k + 1], k * _SEGMENT
        v = values[i : i + _SEGMENT + length]
        v = BYTE_VALUES[which][v] if v.dtype == np.uint8 else _mixed(v) if which else v
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * up[: len(v)], out=total[1:])
        p = at[lo:hi] - i
        out[lo:hi] = (total[p + length] - total[p]) * down[p]
    return _mixed(out)


def both(values: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints, and those of the second polynomial."""
    return fingerprints(values, length, at), fingerprints(values, length, at, 1)


def _sorted(prints: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by fingerprint and check, and where each distinct one begins in it."""
    order = np.argsort(prints, kind="stable")
    s, c = prints[order], checks[order]
    if ((s[1:] == s[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, prints))
        s, c = prints[order], checks[order]
    return order, np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]) if len(s) else np.zeros(0, np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Small non-negative numbers as compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _steps(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The documents that occur, their counts and packed position steps; entries are sorted by document, position."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    steps = np.diff(pos, prepend=0)
    steps[first] = pos[first]
    return doc[first], np.diff(np.r_[first, len(doc)]), packed(steps)


def _positions(counts: np.ndarray, data: bytes) -> np.ndarray:
    total = np.cumsum(unpacked(data), dtype=np.int64)
    ends = np.cumsum(counts)
    before = np.r_[0, total[ends[:-1] - 1]] if len(counts) else np.zeros(0, np.int64)
    return total - np.repeat(before, counts)


PACKED = "bucket int, tid binary, did binary, counts binary, steps binary, prints binary, checks binary, known binary, ktid binary, kcounts binary, ksteps binary"


def rows_for_buckets(both, doc, pos, tids, dids, buckets: int, mode: str):
    """Pack one chunk's windows into a row for each bucket.

    mode: "repeat" (any two places), "shared" (two texts) or "later" (a text with a smaller did has it).
    What the chunk alone already decides is pre-aggregated: such windows are sent once, as known, and the
    positions travel without fingerprints.
    """
    prints, checks = both
    n = len(prints)
    to = ((checks >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
    checks = checks.astype(np.uint16)
    order, start = _sorted(prints, checks)
    size = np.diff(np.r_[start, n])
    settled, sent, known = np.zeros(n, bool), np.ones(n, bool), np.zeros(n, bool)
    if mode == "repeat":
        many = size >= 2
    elif n:
        who = (tids if mode == "shared" else dids)[doc[order]]
        low = np.minimum.reduceat(who, start)
        many = low != np.maximum.reduceat(who, start)
    if n and mode == "later":
        settled[order] = who > np.repeat(low, size)
        sent = ~settled
    elif n:
        settled[order] = np.repeat(many, size)
        witness = order[start[many]]
        sent = ~settled
        sent[witness] = known[witness] = True
    parts = {}
    for name, chosen in (("sent", np.flatnonzero(sent)), ("settled", np.flatnonzero(settled))):
        chosen = chosen[np.argsort(to[chosen], kind="stable")]
        edges = np.searchsorted(to[chosen], np.arange(buckets + 1))
        parts[name] = chosen, edges
    for b in range(buckets):
        mine, settled_here = (c[e[b] : e[b + 1]] for c, e in parts.values())
        if len(mine) or len(settled_here):
            d, counts, steps = _steps(doc[mine], pos[mine])
            kd, kcounts, ksteps = _steps(doc[settled_here], pos[settled_here])
            yield (b, tids[d].tobytes(), dids[d].tobytes(), counts.astype(np.uint32).tobytes(), steps, prints[mine].tobytes(), checks[mine].tobytes(), np.packbits(known[mine]).tobytes(), tids[kd].tobytes(), kcounts.astype(np.uint32).tobytes(), ksteps)


_ARROW = pa.schema([("bucket", pa.int32())] + [(x, pa.binary()) for x in ("tid", "did", "counts", "steps", "prints", "checks", "known", "ktid", "kcounts", "ksteps")])


def as_batches(rows, most: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held), _ARROW)], schema=_ARROW)


def chunks(batch: pa.RecordBatch, most: int = CHUNK_BYTES):
    """(first row, end row) of runs of a batch's documents with at most so many bytes of text."""
    _, at = common.texts(batch.column("text"))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


PLACED = "part int, tid binary, counts binary, steps binary"


def _found(mode: str, parts: int):
    """The repeated windows of a bucket, packed into a row for each part of the texts."""

    def bucket(key, rows):
        tid, did, pos, prints, checks, known, ktid, kpos = [], [], [], [], [], [], [], []
        for r in rows.select(["tid", "did", "counts", "steps", "prints", "checks", "known", "ktid", "kcounts", "ksteps"]).to_batches():
            for row in zip(*r.columns):
                t, d, c, s, p, h, k, kt, kc, ks = (x.as_py() for x in row)
                c, kc = np.frombuffer(c, np.uint32).astype(np.int64), np.frombuffer(kc, np.uint32).astype(np.int64)
                tid.append(np.repeat(np.frombuffer(t, np.int64), c))
                if mode == "later":
                    did.append(np.repeat(np.frombuffer(d, np.int64), c))
                pos.append(_positions(c, s).astype(np.int32))
                prints.append(np.frombuffer(p, np.uint64))
                checks.append(np.frombuffer(h, np.uint16))
                known.append(np.unpackbits(np.frombuffer(k, np.uint8), count=int(c.sum())).astype(bool))
                ktid.append(np.repeat(np.frombuffer(kt, np.int64), kc))
                kpos.append(_positions(kc, ks).astype(np.int32))
        tid, pos, prints, checks, known, ktid, kpos = map(np.concatenate, (tid, pos, prints, checks, known, ktid, kpos))
        order, start = _sorted(prints, checks)
        del prints, checks
        size = np.diff(np.r_[start, len(order)])
        if not len(order):
            hit = np.zeros(0, bool)
        elif mode == "later":
            did = np.concatenate(did)
            hit = did[order] > np.repeat(np.minimum.reduceat(did[order], start), size)
        else:
            t = tid[order]
            some = np.logical_or.reduceat(known[order], start) | (np.minimum.reduceat(t, start) != np.maximum.reduceat(t, start))
            if mode == "repeat":
                p = pos[order]
                some |= np.minimum.reduceat(p, start) != np.maximum.reduceat(p, start)
            hit = np.repeat(some, size) & ~known[order]
        order = order[hit]
        tid, pos = _once(np.r_[tid[order], ktid], np.r_[pos[order], kpos])
        part = tid % parts
        order = np.argsort(part, kind="stable")
        tid, pos = tid[order], pos[order]
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(edges)):
            t, counts, steps = _steps(tid[edges[p] : edges[p + 1]], pos[edges[p] : edges[p + 1]])
            out.append((int(p), t.tobytes(), counts.astype(np.uint32).tobytes(), steps))
        names = ("part", "tid", "counts", "steps")
        return pa.table({n: pa.array(x, pa.int32() if n == "part" else pa.binary()) for n, x in zip(names, zip(*out) if out else [()] * 4)})

    return bucket


def _once(tid: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by text and position, each once."""
    order = np.lexsort((pos, tid))
    tid, pos = tid[order], pos[order]
    fresh = np.r_[True, (tid[1:] != tid[:-1]) | (pos[1:] != pos[:-1])] if len(tid) else np.zeros(0, bool)
    return tid[fresh], pos[fresh]


def _gathered(key, rows):
    tid, pos = [], []
    for r in rows.select(["tid", "counts", "steps"]).to_batches():
        for t, c, s in zip(*(x.to_pylist() for x in r.columns)):
            c = np.frombuffer(c, np.uint32).astype(np.int64)
            tid.append(np.repeat(np.frombuffer(t, np.int64), c))
            pos.append(_positions(c, s))
    tid, pos = _once(np.concatenate(tid), np.concatenate(pos))
    first = np.flatnonzero(np.r_[True, tid[1:] != tid[:-1]]) if len(tid) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(tid)].astype(np.int32)), pa.array(pos.astype(np.int32)))
    return pa.table({"tid": pa.array(tid[first]), "pos": lists})


#: Buckets of fingerprints for each shuffle partition; a task sorts one of them at a time.
BUCKETS = 3


def buckets(spark) -> int:
    return BUCKETS * common.partitions(spark)


def repeated(packed_rows: DataFrame, mode: str, parts_of_six: int = 4) -> DataFrame:
    """(tid, pos array<int>), one row for each text with repeated windows, from rows of `rows_for_buckets`.

    A bucket holds a share of all fingerprints, whatever the documents: a text or passage that a third of
    the rows hold spreads over the buckets, and comes once from each chunk. What is found goes back packed,
    a row for each bucket and part of the texts, so rows do not grow with texts times buckets. parts_of_six: parts for
    six shuffle partitions; fewer do where few positions come back.
    """
    parts = max(1, parts_of_six * common.partitions(packed_rows.sparkSession) // 6)
    hits = packed_rows.groupBy("bucket").applyInArrow(_found(mode, parts), PLACED)
    return hits.groupBy("part").applyInArrow(_gathered, "tid long, pos array<int>")


def runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [from, to) covered by windows of a length that start at ascending places."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length


class Values(dict):
    """64-bit values of words, kept between texts up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value
