"""Removal of long byte strings that repeat anywhere in a corpus, by blockwise suffix buckets over a difference cover.

A difference cover D of period v holds, for any two positions p and q, an offset d < v with (p + d) mod v and
(q + d) mod v both in D. So if the same `length` bytes start at p and at q, some cover position within v - 1 bytes
of p starts `length - v + 1` bytes that also start at a cover position near q. That gives two rounds:

1. the cover sample (6.5 % of all suffixes) is ranked to the depth `length - v + 1`, bucket by bucket: a sample
   suffix whose class has no second member cannot lie in a repeat;
2. only suffixes that reach a sample suffix of a shared class are sorted, one bucket at a time, to the full
   depth; nothing deeper than `length` is ever compared, so one long copy costs no more than many short ones.

Only equality to the given depth is asked for, so classes are ordered by 64-bit fingerprint, not by bytes, and
no bucket, rank table or suffix array of the corpus is held in one place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows


#: Bytes of a passage that documents may share: about 40 words, so that one of more than 50 is as good as never shorter.
PASSAGE = 250
#: Bytes of text whose candidate suffixes, which may be all of them, are held at once.
CANDIDATE_BYTES = 2 << 20


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """Colbourn and Ling's cover: period 24 r^2 + 36 r + 13 with 6 r + 4 members."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps])


def _cover_for(length: int) -> tuple[int, np.ndarray]:
    """The sparsest cover that leaves samples a depth of 16 bytes, or else a sixth of the length, or more."""
    r = 0
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= length - max(16, length // 7):
        r += 1
    return difference_cover(r) if 13 < length else (1, np.zeros(1, np.int64))


#: Period and members of the cover at whose positions shared passages are looked for.
_THIRD = difference_cover(0)


def _sampled(length: int, buckets: int):
    def sample(batches):
        v, cover = _cover_for(length)
        depth = length - v + 1
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            data = np.frombuffer(raw, np.uint8)
            tid = batch.column("tid").to_numpy(zero_copy_only=False)
            for i, j in windows.chunks(batch):
                _, rows = np.unique(tid[i:j], return_index=True)  # copies within a chunk count once
                rows = np.sort(rows) + i
                rows = rows[at[rows + 1] - at[rows] >= length]
                if not len(rows):
                    continue
                most = int((at[rows + 1] - at[rows]).max())
                grid = (np.arange(most // v + 1)[:, None] * v + cover).ravel()
                pos = [grid[: np.searchsorted(grid, n - depth + 1)] for n in at[rows + 1] - at[rows]]
                doc = np.repeat(np.arange(len(rows)), [len(x) for x in pos])
                pos = np.concatenate(pos)
                prints = windows.both(data[at[i] : at[j]], depth, pos + at[rows][doc] - at[i])
                yield from windows.as_batches(windows.rows_for_buckets(prints, doc, pos, tid[rows], tid[rows], buckets, "repeat"))

    return sample


def _candidates(length: int, least: int, buckets: int, mode: str):
    """Suffixes that reach a sample suffix of a shared class; for shared passages only those at positions of a cover."""

    def suffixes(batches):
        v, _ = _cover_for(least)
        period, members = _THIRD
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            data, tid = np.frombuffer(raw, np.uint8), batch.column("tid").to_numpy(zero_copy_only=False)
            found = batch.column("pos")
            for i, j in windows.chunks(batch, CANDIDATE_BYTES):
                doc, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                _, once = np.unique(tid[i:j], return_index=True)  # rows that repeat count once
                for k in (np.sort(once) + i).tolist():
                    n, hits = int(at[k + 1] - at[k]) - length + 1, found[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    if n < 1:
                        continue
                    reach = np.zeros(n + 1, np.int32)
                    np.add.at(reach, np.clip(hits - v + 1, 0, n), 1)
                    np.add.at(reach, np.clip(hits + 1, 0, n), -1)
                    p = np.flatnonzero(np.cumsum(reach[:n]) > 0)
                    if mode == "shared":
                        p = p[np.isin(p % period, members)]
                    pos.append(p)
                    doc.append(np.full(len(p), k - i))
                doc, pos = np.concatenate(doc), np.concatenate(pos)
                if len(pos):
                    prints = windows.both(data[at[i] : at[j]], length, pos + at[i:j][doc] - at[i])
                    yield from windows.as_batches(windows.rows_for_buckets(prints, doc, pos, tid[i:j], tid[i:j], buckets, mode))

    return suffixes


def _places(cell) -> np.ndarray:
    return np.sort(cell.values.to_numpy(zero_copy_only=False)).astype(np.int64) if cell.is_valid else np.zeros(0, np.int64)


def _cut(length: int, passage: int):
    def cut(batches):
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            tid, found, shared = batch.column("tid"), batch.column("starts"), batch.column("shared")
            out = []
            for k in range(batch.num_rows):
                text = raw[at[k] : at[k + 1]]
                a, b = windows.runs(_places(found[k]), length)
                c, d = windows.runs(_places(shared[k]), passage)
                digest, last = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist()):
                    digest.update(text[last:x])
                    last = y
                digest.update(text[last:])
                out.append((int((b - a).sum()), len(a), digest.hexdigest(), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())], int((d - c).sum())))
            cols = list(zip(*out)) if out else [()] * 5
            spans = pa.array(cols[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([tid, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), spans, pa.array(cols[4], pa.int64())], ["tid", "n_removed", "n_spans", "kept_sha256", "spans", "n_shared"])

    return cut


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", passage: int = PASSAGE) -> DataFrame:
    """What is left of each text when every byte in a repeated string of `length` bytes goes.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document or in
    another; overlapping repeats count, matches never cross documents, and strings are judged on the input.

    Returns a row for each row of docs: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans
    (array of [start, end) in bytes), and n_shared: bytes in strings of `passage` bytes that another document also has,
    looked for at 4 of 13 positions, so that documents which share `passage` + 12 bytes always have some; nothing is
    removed for these. A null or empty text has no bytes and keeps nothing. Rows that repeat,
    also with the same or a null key, are documents of their own: copies of `length` bytes or more go whole. Other
    columns are ignored; an empty table gives an empty result. Texts are told apart by their SHA-256. key holds whole
    numbers (or text that reads as such).
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("did"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, small = common.told_apart(rows, lambda df: df.select("did", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")))
    texts = common.written(small.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("first")))
    buckets = windows.buckets(spark)

    least = min(length, passage)
    sample = common.written(windows.repeated(rows.select("tid", "text").mapInArrow(_sampled(least, buckets), windows.PACKED), "repeat"))
    wanted = texts.join(sample, "tid").withColumnRenamed("tid", "wtid")
    # one row of each text: by text and key, so that the copies of a text are dealt out
    reached = rows.join(wanted, (F.col("tid") == F.col("wtid")) & F.col("did").eqNullSafe(F.col("first"))).select("tid", "n", "text", "pos")
    reached = common.written(reached)
    common.dropped(sample)
    found = lambda size, mode, parts: windows.repeated(reached.select("tid", "text", "pos").mapInArrow(_candidates(size, least, buckets, mode), windows.PACKED), mode, parts)
    shared = common.written(found(passage, "shared", 3).withColumnRenamed("pos", "shared"))
    starts = common.written(found(length, "repeat", 4).withColumnRenamed("pos", "starts"))
    both = starts.join(shared, "tid", "full")
    schema = "tid long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, n_shared long"
    cut = common.written(reached.where("n = 1").join(both, "tid").select("tid", "text", "starts", "shared").mapInArrow(_cut(length, passage), schema))
    for x in (starts, shared, reached):
        common.dropped(x)

    many = texts.where("n > 1").select("tid", "n")
    flagged = small.join(common.hot(many, "n", small.count()).withColumnRenamed("n", "hot"), "tid", "left")
    rest = flagged.where("hot is null").drop("hot").join(many, "tid", "left").join(cut, "tid", "left")
    none = {"n_removed": "long", "n_spans": "long", "kept_sha256": "string", "spans": "array<struct<start:long,end:long>>", "n_shared": "long"}
    crowd = flagged.where("hot is not null").withColumnRenamed("hot", "n").withColumns({k: F.lit(None).cast(v) for k, v in none.items()})
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    return rest.unionByName(crowd).select(
        F.col("did").alias(key),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when((F.col("n") > 1) & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("n_shared", F.lit(0))).cast("long").alias("n_shared"),
    )
