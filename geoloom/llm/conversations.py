"""Repair of conversation structure: the cheapest edits that make roles alternate, found in one sorted stream.

Rows are repartitioned by conversation and sorted by turn (ties by role, then text); a task carries the state of a
dynamic program (four states of the grammar `(s?(ua)+)?`: nothing yet, after the system, a user, an assistant row) across
Arrow batches. Rows wait only until the cheapest ways to all states agree on them, and then leave the task; where they do
not agree for long, waiting rows and one byte a row and state to trace back by go to a file of the task. So a giant
conversation needs no more memory than a short one. Whether its texts were seen earlier is then told by Spark, which
counts rows of conversations first, and not by a set in the task.

Faults (each row's first counts): blank (no character but white space), duplicate (role and text of an earlier row),
truncated (the last character that is no white space ends no sentence). Edits: Keep 0, Rerole to user or assistant 2,
Delete 3 (the only one for blank and duplicate rows), Insert an empty user or assistant row 2; truncated rows that stay
add 1. Among cheapest repairs the one whose edits read least in ASCII (D, I, K, R) is taken.

A null role or text counts as empty (so blank); a null turn comes first; a null conversation is one of its own; rows that
repeat whole are duplicates of the first. A role counts by its first letter, an empty one fits nowhere. An empty table
gives no row; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Conversations of more rows have their duplicates told by Spark.
GIANT = 200_000
#: Bytes of waiting texts, and of trails, that a task holds in memory.
SPILL = 8 << 20
#: Rows after which a task first looks for what all ways agree on.
LOOK = 512

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_ROLE = {"u": "user", "a": "assistant"}
_LETTERS = "DKR"
_BLANK = "\x20\t\n\x0b\x0c\r"
_NONE = 255


def _inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = _AFTER[_WANTED[state], state]
    return state


@functools.cache
def _moves(initial: str, gone: bool, cut: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of one row: inserts before it, then its own edit."""
    best: dict = {}
    for a in range(4):
        for n in range(3):
            z = _inserted(a, n)
            ways = [(z, DELETE, "D")]
            if not gone:
                if (initial, z) in _AFTER:
                    ways.append((_AFTER[initial, z], KEEP + TRUNCATED * cut, "K"))
                ways.append((_inserted(z, 1), REROLE + TRUNCATED * cut, "R"))
            for b, cost, letter in ways:
                way = (cost + INSERT * n, "I" * n + letter)
                best[a, b] = min(best.get((a, b), way), way)
    return [(a, b, *way) for (a, b), way in best.items()]


@functools.lru_cache(1 << 16)
def _step(at: tuple, kind: tuple) -> tuple[tuple, int, bytes]:
    """(costs above the least, with ranks), the least cost, and for each state the way back: from, inserts, edit.

    at has for each state (cost, rank) or None; ranks order the edits of states so far. Edits up to a row's own edit are
    never the beginning of one another, so their order is that of their states' ranks, and then of the new edits.
    """
    best: list = [None] * 4
    for a, b, cost, edits in _moves(*kind):
        if at[a] is not None:
            way = (at[a][0] + cost, at[a][1], edits, a)
            if best[b] is None or way < best[b]:
                best[b] = way
    low = min(w[0] for w in best if w)
    ranks = {b: k for k, b in enumerate(sorted((b for b in range(4) if best[b]), key=lambda b: best[b][1:3]))}
    new = tuple(w and (w[0] - low, ranks[b]) for b, w in enumerate(best))
    return new, low, bytes(_NONE if w is None else w[3] | (len(w[2]) - 1) << 2 | _LETTERS.index(w[2][-1]) << 4 for w in best)


def _last(at: tuple) -> tuple[int, int]:
    """The state and the inserts that end a conversation best."""
    ways = [(at[a][0] + INSERT * n, at[a][1], "I" * n, a) for a in range(4) if at[a] for n in range(3) if n == 0 and a == START or _inserted(a, n) == ASSISTANT]
    _, _, edits, a = min(ways)
    return a, len(edits)


class _Waiting:
    """Rows not yet decided, and for each the way back from each state (4 bytes); both go to files when they are many."""

    def __init__(self):
        self.rows, self.size, self.n, self.file = [], 0, 0, None
        self.trail = tempfile.SpooledTemporaryFile(max_size=SPILL)
        self.pending = bytearray()

    def add(self, row: tuple, back: bytes) -> None:
        self.rows.append(row)
        self.pending += back
        self.n += 1
        self.size += 64 + len(row[2])
        if self.size > SPILL:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0
        if len(self.pending) > SPILL:
            self._flush()

    def _flush(self) -> None:
        self.trail.seek(0, 2)
        self.trail.write(self.pending)
        self.pending = bytearray()

    def _blocks(self, upto: int):
        """(place of the first row, its bytes) of blocks of the trail, last block first."""
        self._flush()
        step = 1 << 16
        for first in range((upto - 1) // step * step, -1, -step):
            self.trail.seek(4 * first)
            yield first, bytearray(self.trail.read(4 * (min(upto, first + step) - first)))

    def agreed(self, states: list[int]) -> tuple[int, int]:
        """How many of the first rows all ways agree on, and the state after these."""
        now = set(states)
        if len(now) == 1:
            return self.n, now.pop()
        for first, block in self._blocks(self.n):
            for i in range(len(block) // 4 - 1, -1, -1):
                now = {block[4 * i + s] & 3 for s in now}
                if len(now) == 1:
                    return first + i, now.pop()
        return 0, START

    def decide(self, upto: int, state: int) -> None:
        """Write each row's decision over the first byte of its trail."""
        for first, block in self._blocks(upto):
            for i in range(len(block) // 4 - 1, -1, -1):
                back = block[4 * i + state]
                state = back & 3
                block[4 * i] = back
            self.trail.seek(4 * first)
            self.trail.write(block)

    def take(self, upto: int):
        """(row, decision) of the first rows, which then no longer wait."""
        rest, self.rows, file = self.rows, [], self.file
        if file is not None:
            file.seek(0)
            self.file = None

        def chunks():
            while file is not None:
                try:
                    yield pickle.load(file)
                except EOFError:
                    break
            yield rest

        old, n, self.trail, self.n, self.size = self.trail, 0, tempfile.SpooledTemporaryFile(max_size=SPILL), 0, 0
        for chunk in chunks():
            old.seek(4 * n)
            block = old.read(4 * len(chunk))
            n += len(chunk)
            for i, row in enumerate(chunk):
                back = block[4 * i : 4 * i + 4]
                if n - len(chunk) + i < upto:
                    yield row, back[0]
                else:
                    self.add(row, back)
        old.close()
        if file is not None:
            file.close()


class _Repair:
    """One conversation's dynamic program."""

    def __init__(self, key, out: list):
        self.key, self.out, self.at, self.state, self.steps = key, out, ((0, 0), None, None, None), START, 0
        self.waiting, self.look = _Waiting(), LOOK
        self.seen: set = set()
        self.before = None

    def fault(self, turn, role: str, text: str, low, null_first) -> str | None:
        shown = text.rstrip(_BLANK)
        same, self.before = self.before == (role, text), (role, text)
        if not shown:
            return "blank"
        if null_first is None:
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            again = digest in self.seen
            self.seen.add(digest)
        else:
            again = same or turn is not None and (null_first or turn > low)
        return "duplicate" if again else "truncated" if shown[-1] not in ".!?" else None

    def row(self, turn, role: str | None, text: str | None, low=None, null_first=None) -> None:
        role, text = role or "", text or ""
        fault = self.fault(turn, role, text, low, null_first)
        kind = (role[:1] if role[:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated")
        self.at, _, back = _step(self.at, kind)
        self.waiting.add((turn, role, text, fault), back)
        if self.waiting.n >= self.look:
            upto, state = self.waiting.agreed([s for s in range(4) if self.at[s]])
            if upto:
                self.given(upto, state)
            self.look = max(LOOK, 2 * self.waiting.n)

    def given(self, upto: int, state: int) -> None:
        self.waiting.decide(upto, state)
        for (turn, role, text, fault), back in self.waiting.take(upto):
            self.inserts(back >> 2 & 3)
            letter = _LETTERS[back >> 4]
            to = _ROLE[_WANTED[self.state]] if letter == "R" else role
            self.edit(letter, turn, to, text, role, fault)
            if letter != "D":
                self.state = _AFTER[to[:1], self.state]

    def inserts(self, n: int) -> None:
        for _ in range(n):
            self.edit("I", None, _ROLE[_WANTED[self.state]], "", None, None)
            self.state = _inserted(self.state, 1)

    def edit(self, *what) -> None:
        self.out.append((self.key, self.steps, *what))
        self.steps += 1

    def end(self) -> None:
        state, inserts = _last(self.at)
        self.given(self.waiting.n, state) if self.waiting.n else None
        self.inserts(inserts)


def _batches(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", giant: int = GIANT) -> DataFrame:
    """One row for each edit, in order (`step`): conv_id, step, edit, turn, role, text, was, fault.

    edit is K, R, D or I; role is the repaired one and was the given one. Rows without edit D, in order of step, are the
    repaired conversation. Rows of a conversation lie in one partition and in order.
    """
    common.bounded_batches(rows.sparkSession)
    kind = rows.schema[conv].dataType
    rows = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = rows.groupBy("conv_id").count().where(F.col("count") > giant).select("conv_id", F.lit(True).alias("giant"))
    if sizes.isEmpty():
        rows = rows.withColumns({"low": F.lit(None).cast("long"), "null_first": F.lit(None).cast("boolean")})
    else:
        sizes = common.small_side(common.written(sizes), 100_000)
        rows = rows.join(sizes.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumn("hash", F.when(F.col("giant"), F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)))
        firsts = rows.where("giant").groupBy("conv_id", "hash").agg(F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("null_first")).select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), "low", "null_first")
        rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")), "left").select("conv_id", "turn", "role", "text", "low", "null_first")
    fields = [("conv_id", kind), ("step", T.LongType()), ("edit", T.StringType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("was", T.StringType()), ("fault", T.StringType())]

    def repaired(batches):
        now, out, schema, size = None, [], None, 0
        for batch in batches:
            if schema is None:
                schema = pa.schema([(n, t) for (n, _), t in zip(fields, [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4])])
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.key != key:
                    if now is not None:
                        now.end()
                    now = _Repair(key, out)
                now.row(*row)
                size += len(row[2])
                if len(out) >= 4096 or out and size > SPILL:
                    yield _batches(out, schema)
                    out.clear()
                    size = 0
        if now is not None:
            now.end()
        if out:
            yield _batches(out, schema)

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return sorted_rows.mapInArrow(repaired, T.StructType([T.StructField(n, t) for n, t in fields]))


class _Digest:
    def __init__(self, key):
        self.key, self.low, self.high, self.turns, self.last = key, None, None, 0, None
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.cost, self.audit, self.sha, self.any, self.initial = 0, 0, bytearray(), hashlib.sha256(), False, None

    def row(self, edit, turn, role, text, was, fault) -> None:
        self.audit += edit.encode()
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
            if turn is not None and turn != self.last:
                self.low, self.high, self.turns, self.last = turn if self.low is None else self.low, turn, self.turns + 1, turn
        if edit != "D":
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True

    def row_of(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


def audits(edits: DataFrame) -> DataFrame:
    """What `repair` did, one row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    edits is the direct result of `repair`: this reads its sorted partitions as a stream, without another shuffle.
    """
    fields = [("conv_id", edits.schema["conv_id"].dataType), *((n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]

    def read(batches):
        now, out, schema = None, [], None
        for batch in batches:
            if schema is None:
                schema = pa.schema([(n, t) for (n, _), t in zip(fields, [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()])])
            for key, step, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if step == 0:
                    if now is not None:
                        out.append(now.row_of())
                    now = _Digest(key)
                now.row(*row)
            if len(out) >= 4096:
                yield _batches(out, schema)
                out = []
        if now is not None:
            out.append(now.row_of())
        if out:
            yield _batches(out, schema)

    return edits.mapInArrow(read, T.StructType([T.StructField(n, t) for n, t in fields]))
