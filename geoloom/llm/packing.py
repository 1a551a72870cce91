"""Packing tokenized documents into sequences of a fixed length: best-fit decreasing over a segment tree of capacities.

One narrow pass: a task tokenizes its documents, cuts overlong ones into full windows at once, holds the rests (less than
a window each, at most `group` of them) and packs these by best fit, longest first. Windows that end up with little
padding are sequences; what lies in the others is laid end to end and cut into full ones, and the last tokens of a task go
into sequences whose lengths are powers of two. Nothing is shuffled, no document is held whole beyond its batch, and a
lost executor costs its tasks alone; a task that runs again gives the same pieces.

Null and empty texts hold the end token alone. Ties of length keep the order of the rows; repeated rows are packed like
any others; an empty table gives no piece; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rests of documents that a task packs at once.
GROUP = 4096
#: Bytes of ids in a batch of pieces.
_OUT = 8 << 20


class Capacities:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest one that an item fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = self.size + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) with the least capacity of at least length, taken out; None if there is none."""
        count, i = self.count, self.size + length
        while not count[i]:
            while i & 1:  # a right child: what is larger lies beyond its parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Windows, each the list of its items' places, of items no longer than a window, longest first."""
    free, out = Capacities(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.tightest(lengths[i])
        if found is None:
            found = window, len(out)
            out.append([])
        out[found[1]].append(i)
        if found[0] > lengths[i]:
            free.put(found[0] - lengths[i], found[1])
    return out


def padding(length: int, window: int) -> int:
    """Tokens that a sequence is padded by: up to the window, but none at a power of two."""
    return 0 if length & (length - 1) == 0 else window - length


def _kind(category: str, c: str) -> str:
    return category[0] if category[0] in "LN" else " " if c.isspace() else "."


@functools.cache
def _unsettled() -> re.Pattern:
    """Characters whose kind (letter, number, space, other) Unicode did not settle early: engines may split them unlike."""
    now, then = unicodedata, unicodedata.ucd_3_2_0
    odd = [c for c in map(chr, range(0x110000)) if then.category(c) == "Cn" or _kind(now.category(c), c) != _kind(then.category(c), c) or c in "\x1c\x1d\x1e\x1f\x85᠎"]
    ranges: list[list[int]] = []
    for c in map(ord, odd):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


@functools.cache
def encoder(path: str):
    """text -> ids of the tokenizer file, as an array.

    A byte-level file whose merges rank by id is also a table of ranks; texts without added tokens and without unsettled
    characters are split by those ranks, which is several times faster, and all other texts by the tokenizer itself.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    plain = lambda t: np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, before = said["model"], said.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or said.get("normalizer"):
        return plain
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    added = {a["content"] for a in said.get("added_tokens", ())}
    ids = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [ids.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if merged != sorted(merged) or merged[:1] == [-1] or any(c not in byte for t in ids for c in t):
        return plain
    import tiktoken

    #: Fixed value: the split of byte-level files.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={bytes(map(byte.__getitem__, t)): i for t, i in ids.items()}, special_tokens={})
    odd, marks = _unsettled().search, re.compile("|".join(map(re.escape, sorted(added))) or "(?!)").search
    western = re.compile(r"[\0-\x1b -\x84\x86-ȟ]*").fullmatch  # settled all of it, and faster to tell
    return lambda t: plain(t) if not western(t) and odd(t) or marks(t) else fast.encode_to_numpy(t)


class _Sequences:
    """Pieces of the sequences of one task, given out in batches."""

    def __init__(self, window: int, schema: pa.Schema):
        self.window, self.schema, self.rows, self.bytes = window, schema, [], 0
        self.next = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

    def add(self, pieces) -> None:
        """One sequence from (key, start, ids, document's tokens)."""
        at = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, at))
            at += len(ids)
        self.bytes += 4 * at
        self.next += 1

    def powers(self, pieces) -> None:
        """The pieces, laid end to end, as sequences whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            pieces = self.cut(pieces, size)
            left -= size

    def cut(self, pieces, size: int) -> list:
        """One sequence from the first tokens of the pieces; the rest of them."""
        taken, i = [], 0
        while size:
            key, start, ids, total = pieces[i]
            n = min(size, len(ids))
            taken.append((key, start, ids[:n], total))
            size -= n
            i += 1
            if n < len(ids):
                i -= 1
                pieces = [*pieces[:i], (key, start + n, ids[n:], total), *pieces[i + 1 :]]
        self.add(taken)
        return pieces[i:]

    def ready(self, all_of_it: bool = False):
        if self.rows and (all_of_it or self.bytes >= _OUT):
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows, self.bytes = [], 0
            yield out


def _packed(held: list, out: _Sequences, slack: int) -> list:
    """Pack the held rests; what is left over, less than a window of tokens."""
    loose = []
    for items in best_fit([len(h[2]) for h in held], out.window):
        pieces = [held[i] for i in items]
        if padding(sum(len(p[2]) for p in pieces), out.window) <= slack:
            out.add(pieces)
        else:
            loose += pieces
    left, first = sum(len(p[2]) for p in loose), 0
    while left >= out.window:
        n, some = 0, []
        while n < out.window:
            some.append(loose[first])
            n += len(loose[first][2])
            first += 1
        rest = out.cut(some, out.window)
        if rest:
            first -= 1
            loose[first] = rest[0]
        left -= out.window
    return loose[first:]


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end: int = 0, key: str = "doc_id", text: str = "text", group: int = GROUP, slack: int | None = None) -> DataFrame:
    """Pieces of sequences of at most `window` tokens: key, start, length, ids, doc_tokens, sequence_id, offset.

    tokenizer is a file of the tokenizers library that every executor has; each document gets the id `end` after its own
    ids. ids is binary, unsigned little-endian 32-bit. A piece starts at `start` in its document (which has doc_tokens
    ids) and at `offset` in its sequence. Sequences count from the task's number times 2**33. A window of rests may be
    padded by `slack` tokens (a 64th of the window unless given); all others are full or a power of two long.
    """
    slack = window // 64 if slack is None else slack
    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    fields = [(key, kind), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    out_schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def pieces(batches):
        encode, out, held = encoder(tokenizer), None, []
        for batch in batches:
            if out is None:
                types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                out = _Sequences(window, pa.schema([(n, t) for (n, _), t in zip(fields, types)]))
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.uint32(end))
                full = len(ids) // window * window
                for start in range(0, full, window):
                    out.add([(k, start, ids[start : start + window], len(ids))])
                    yield from out.ready()
                if full < len(ids):
                    held.append((k, full, ids[full:].copy(), len(ids)))
                if len(held) >= group:
                    held = _packed(held, out, slack)
                    yield from out.ready()
        if out is not None:
            out.powers(_packed(held, out, slack))
            yield from out.ready(all_of_it=True)

    return docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text" if key != "text" else "words")).mapInArrow(pieces, out_schema)
