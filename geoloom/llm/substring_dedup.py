"""Removal of word windows that an earlier document holds, by level-wise doubling.

Windows of a few words come first, and of those only one in each longer window (the one with the smallest fingerprint,
so equal longer windows choose alike). A longer window whose chosen part no second text repeats is done. What survives
alone is looked at with windows of twice that length (cut to the asked one), and so on up to the asked length; where the
lengths of repeats are asked for, on beyond it until no candidate survives.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

#: Stands for a null key, which counts as smaller than all others.
_NULL = -(1 << 63)


def _values(raw, at, i: int, j: int, kept: windows.Values) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts i..j as 64-bit values, and where each text begins and the last one ends."""
    words, edges = [], [0]
    for k in range(i, j):
        words += bytes(raw[at[k] : at[k + 1]]).split()
        edges.append(len(words))
    return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words)), np.array(edges)


#: Words of the windows of the first level at most. Shorter ones repeat nearly everywhere and would decide nothing.
SHORTEST = 4


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths that end at the asked one, each at most twice the one before."""
    out = [length]
    while out[0] > max(1, shortest):
        out.insert(0, (out[0] + 1) // 2)
    return out


def _chosen(values: np.ndarray, edges: np.ndarray, length: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of `length` words in a text: its start, its text, and the start of its part with the smallest fingerprint."""
    none = np.zeros(0, np.int64)
    if len(values) < length:
        return none, none, none
    n = len(values) - length + 1
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[:n]
    inside = np.flatnonzero(np.arange(n) + length <= edges[1:][doc])
    if part == length:
        return inside, doc[inside], inside
    prints = windows.fingerprints(values, part, np.arange(len(values) - part + 1))
    low, where = prints[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, length - part + 1):
        less = prints[k : k + n] < low
        low[less], where[less] = prints[k : k + n][less], k
    return inside, doc[inside], inside + where[inside]


def _level(length: int, before: int | None, part: int, buckets: int, mode: str):
    """Of the windows of `length` words whose chosen part of `before` words is among the found ones, the chosen part of
    `part` words: what a second text must repeat (shared), or an earlier one have (later), for the window to survive."""

    def level(batches):
        kept = windows.Values()
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            tid = batch.column("tid").to_numpy(zero_copy_only=False)
            did = batch.column("did").to_numpy(zero_copy_only=False) if mode == "later" else tid
            found = batch.column("pos") if before else None
            for i, j in windows.chunks(batch):
                values, edges = _values(raw, at, i, j, kept)
                alive = np.zeros(len(values) + 1, bool)
                _, first = np.unique(tid[i:j], return_index=True)
                _, doc, pos = _chosen(values, edges, length, part)
                mine = np.isin(doc, first)  # rows that repeat count once
                if before:
                    for k in range(i, j):
                        alive[found[k].values.to_numpy(zero_copy_only=False) + edges[k - i]] = True
                    mine &= alive[_chosen(values, edges, length, before)[2]]
                pos, once = np.unique(pos[mine], return_index=True)  # windows share parts
                doc = doc[mine][once]
                both = windows.both(values, part, pos)
                yield from windows.as_batches(windows.rows_for_buckets(both, doc, pos - edges[doc], tid[i:j], did[i:j], buckets, mode))

    return level


def _longer(length: int, buckets: int):
    """Windows of twice the length whose two halves both survived."""

    def longer(batches):
        kept = windows.Values()
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            tid, did = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("tid", "did"))
            found = batch.column("pos")
            for i, j in windows.chunks(batch):
                values, edges = _values(raw, at, i, j, kept)
                pos, doc = [], []
                for k in range(i, j):
                    p = np.sort(found[k].values.to_numpy(zero_copy_only=False)).astype(np.int64)
                    p = p[np.isin(p + length, p)]
                    pos.append(p)
                    doc.append(np.full(len(p), k - i))
                pos, doc = np.concatenate(pos), np.concatenate(doc)
                both = windows.both(values, 2 * length, pos + edges[doc])
                yield from windows.as_batches(windows.rows_for_buckets(both, doc, pos, tid[i:j], did[i:j], buckets, "shared"))

    return longer


def _whole(batches):
    for batch in batches:
        raw, at = common.texts(batch.column("text"))
        out = []
        for k in range(batch.num_rows):
            words = bytes(raw[at[k] : at[k + 1]]).split()
            out.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        n, whole = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("tid"), pa.array(n, pa.int64()), pa.array(whole, pa.string())], ["did", "tid", "n_words", "whole"])


def _cut(length: int):
    def cut(batches):
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            out = []
            for k, starts in enumerate(batch.column("starts")):
                words = bytes(raw[at[k] : at[k + 1]]).split()
                a, b = windows.runs(np.sort(starts.values.to_numpy(zero_copy_only=False)).astype(np.int64), length)
                spans = list(zip(a.tolist(), b.tolist()))
                kept, last = [], 0
                for x, y in spans:
                    kept += words[last:x]
                    last = y
                kept += words[last:]
                out.append((len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": x, "end": y} for x, y in spans]))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["tid", "n_removed", "kept_sha256", "spans"])

    return cut


def remove_seen(docs: DataFrame, length: int = 13, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """What is left of each text when every word in a window that an earlier document also holds goes.

    Words are runs of other characters than space and \\t to \\r. A word goes if a window of `length` words that
    covers it also starts in a document with a smaller key; windows are judged on the input. shortest: words of the
    windows of the first level at most.

    Returns a row for each row of docs: key, n_words, n_removed, kept_sha256 (kept words joined by one space), and
    spans (array of [start, end) in words). A null or empty text has no words. A null key counts as smaller than all
    others; rows of the same key take nothing from each other, repeated ones fare alike. Other columns are ignored; an
    empty table gives an empty result. Texts are told apart by the SHA-256 of their words. key holds whole numbers (or
    text that reads as such).
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = _rows(docs, key, text)
    rows, small = common.told_apart(rows, lambda df: df.select("did", "tid", "text").mapInArrow(_whole, "did long, tid long, n_words long, whole string"))
    texts = common.written(_texts(small))
    lengths, buckets = levels(length, shortest), windows.buckets(spark)
    found, reached = _survivors(rows, texts, length, lengths[:-1], buckets)
    before = lengths[-2] if len(lengths) > 1 else None
    starts = common.written(windows.repeated(reached.mapInArrow(_level(length, before, length, buckets, "later"), windows.PACKED), "later").withColumnRenamed("pos", "starts"))
    cut = common.written(reached.join(starts, "tid").select("tid", "text", "starts").mapInArrow(_cut(length), "tid long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"))
    for x in (found, reached, starts):
        common.dropped(x)

    crowded = common.hot(texts.select("tid", "n", F.col("first").alias("hot")), "n", small.count()).drop("n")
    flagged = small.join(crowded, "tid", "left")
    again = (F.col("hot").isNotNull()) & (F.col("did") > F.col("hot"))  # a later copy of a text that very many rows hold
    rest = flagged.where(~again).drop("hot").join(texts.select("tid", "first").join(cut, "tid", "left"), "tid")
    none = {"n_removed": "long", "kept_sha256": "string", "spans": "array<struct<start:long,end:long>>"}
    crowd = flagged.where(again).withColumnRenamed("hot", "first").withColumns({k: F.lit(None).cast(v) for k, v in none.items()})
    whole = (F.col("did") > F.col("first")) & (F.col("n_words") >= length)
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    return rest.unionByName(crowd).select(
        F.when(F.col("did") != _NULL, F.col("did")).alias(key),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("did"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _texts(rows: DataFrame) -> DataFrame:
    """Each text's smallest key, its rows, and those of them with that key: (tid, n, first, n_first)."""
    counted = rows.groupBy("tid", "did").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("tid").agg(F.sum("n").alias("n"), F.min("did").alias("first"), F.min_by("n", "did").alias("n_first"))


def _survivors(rows: DataFrame, texts: DataFrame, length: int, lengths: list[int], buckets: int) -> tuple[DataFrame | None, DataFrame]:
    """The last level's parts that a second text repeats, by text; and the texts that hold some, each once, with them."""
    found, reached = None, rows.select("tid", "did", "text")
    for before, part in zip([None, *lengths], lengths):
        level = reached.mapInArrow(_level(length, before, part, buckets, "shared"), windows.PACKED)
        after = common.written(windows.repeated(level, "shared"))
        if found is None:
            # one row of each text: by text and key, so that the copies of a text are dealt out
            wanted = texts.select(F.col("tid").alias("wtid"), "first", "n_first").join(after.withColumnRenamed("tid", "wtid"), "wtid")
            some = rows.join(wanted, (F.col("tid") == F.col("wtid")) & (F.col("did") == F.col("first"))).select("tid", "did", "text", "pos", "n_first")
            held = common.written(some)
            # only rows that repeat are dealt out again, combined before that; most texts have none
            once = held.where("n_first > 1").dropDuplicates(["tid"])
            fresh = held.where("n_first = 1").unionByName(once).drop("n_first")
            fresh._written_at = held._written_at
        else:
            fresh = common.written(reached.drop("pos").join(after, "tid"))
            common.dropped(found)
            common.dropped(reached)
        found, reached = after, fresh
    if found is None:  # a length of one level: every text, each once
        single = rows.join(texts.select(F.col("tid").alias("wtid"), "first", "n_first"), (F.col("tid") == F.col("wtid")) & (F.col("did") == F.col("first")))
        return common.written(texts.limit(0)), common.written(single.select("tid", "did", "text").dropDuplicates(["tid"]))
    return found, reached


def repeat_lengths(docs: DataFrame, length: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How long the repeats of each text are: a row (key, longest) for each row whose text shares a window.

    From windows that two texts share at `length` words on, only survivors are extended to twice that length,
    until no candidate survives; longest is the last length (length * 2**k) at which the text still shared one.
    Nulls, empty texts and repeated rows as in `remove_seen`; equal texts do not count as two.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows, small = common.told_apart(_rows(docs, key, text), lambda df: df.select("did", "tid", F.sha2("text", 256).alias("whole")))
    buckets, lengths = windows.buckets(spark), levels(length)
    found, reached = _survivors(rows, common.written(_texts(small)), length, lengths[:-1], buckets)
    before = lengths[-2] if len(lengths) > 1 else None
    level = common.written(windows.repeated(reached.mapInArrow(_level(length, before, length, buckets, "shared"), windows.PACKED), "shared"))
    common.dropped(found)
    lasting, n = common.written(level.select("tid", F.lit(length).cast("long").alias("longest"))), length
    while not level.isEmpty():
        longer = reached.select("tid", "did", "text").join(level, "tid")
        after = common.written(windows.repeated(longer.mapInArrow(_longer(n, buckets), windows.PACKED), "shared"))
        common.dropped(level)
        level, n, known = after, 2 * n, lasting
        lasting = common.written(known.unionByName(level.select("tid", F.lit(n).cast("long").alias("longest"))).groupBy("tid").agg(F.max("longest").alias("longest")))
        common.dropped(known)
    common.dropped(reached)
    return small.select("did", "tid").join(lasting, "tid").select(F.when(F.col("did") != _NULL, F.col("did")).alias(key), "longest")
