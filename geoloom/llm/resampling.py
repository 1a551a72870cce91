"""Importance resampling towards a target: documents whose hashed word n-grams look like the target's are drawn more often.

A text is lower-cased (A to Z), its separators are collapsed to single spaces, and one overlapped regular expression scan
with a boundary look-behind gives at each word its n-grams of each order; their CRC-32 counts them into buckets. Each
document's buckets are written once, sorted and as differences (about a byte for each n-gram), so texts are scanned once.
Bucket counts of all documents and of all target texts give each bucket a gain; a document's weight is the sum of its
features' gains, and a draw without repeats takes the highest weights after Gumbel noise of a seeded hash of the key.

Null and empty texts, and those without words, have no features, weight 0 and, having too few words, no rank. Very long
texts are scanned in slices of matches. Ties of score go to the smaller key (a null key last, hashed as an empty one), then
to fewer features; repeated rows score alike and are drawn one by one. An empty table gives no row; an empty target gives
gains from the documents alone. Other columns are not read, so their names cannot clash; `drawn` passes them on.
"""

from __future__ import annotations

import functools
import math
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Matches of a text that are counted at once.
_SLICE = 50_000
_SEPARATORS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
#: A to Z lower-cased, and then each separator a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _SEPARATORS else b for b in range(256))


@functools.cache
def _scanner(orders: int):
    import regex

    pattern = rb"([^ ]++)"
    for _ in range(orders - 1):
        pattern = rb"(" + pattern + rb"(?: [^ ]++)?)"
    return regex.compile(rb"(?<= )" + pattern)


def features(text: str | None, orders: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words, and the sorted buckets of all runs of 1 to `orders` words."""
    flat = b" " + b" ".join((text or "").encode().translate(_FOLD).split())
    words = flat.count(b" ") if len(flat) > 1 else 0
    scan, found, first = _scanner(orders).finditer(flat, overlapped=True), [], 0
    while matches := [m.groups() for m in islice(scan, _SLICE)]:
        for k, grams in enumerate(zip(*matches)):  # the longest runs first; the last words of a text begin shorter ones only
            n = max(0, min(len(grams), words - (orders - k) + 1 - first))
            found.append(np.fromiter(map(crc32, grams[:n]), np.uint32, n) % np.uint32(buckets))
        first += len(matches)
    return words, np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", orders: int = 3, buckets: int = 10_000) -> DataFrame:
    """key, tid (a hash of the text), n_words, n_features and found: the sorted buckets' differences as binary."""
    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    width = _width(buckets)

    def counted(batches):
        for batch in batches:
            words, sizes, found = [], [], []
            for t in batch.column(2):
                n, b = features(t.as_py(), orders, buckets)
                words.append(n)
                sizes.append(len(b))
                found.append(np.diff(b, prepend=np.uint32(0)).astype(width).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=[key, "tid", "n_words", "n_features", "found"])

    schema = T.StructType([T.StructField(n, t) for n, t in ((key, kind), ("tid", T.LongType()), ("n_words", T.LongType()), ("n_features", T.LongType()), ("found", T.BinaryType()))])
    texts = F.col(text).cast("string")
    return docs.select(F.col(key).alias(key), F.xxhash64(texts).alias("tid"), texts.alias("words" if key != "words" else "text")).mapInArrow(counted, schema)


def _counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features of each bucket: each task sums its own, Spark adds them up; the driver gets one number a bucket."""
    width = _width(buckets)

    def summed(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.cumsum(np.frombuffer(b.as_py(), width), dtype=np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("found").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's share in the target to that in the corpus, one added to each count."""
    s, t, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((int(y) + 1) * float(s + b) / ((int(x) + 1) * float(t + b)))) for x, y in zip(corpus, target)], np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, key: str = "doc_id", text: str = "text", target_text: str = "text", orders: int = 3, buckets: int = 10_000) -> DataFrame:
    """Every document's key, tid, n_words, n_features, weight, score, and rank (1, 2, ... for the drawn ones, else null).

    floor(percent * N / 100) of the N documents with at least `least_words` words are drawn. Scores are sorted by ranges
    and written; a rank is a row's place in its part and the number of rows in the parts before it.
    """
    spark = docs.sparkSession
    found = common.written(measured(docs, key, text, orders, buckets))
    wanted = measured(target.select(F.lit(0).alias("_"), F.col(target_text).alias("words")), "_", "words", orders, buckets)
    gain = spark.sparkContext.broadcast(gains(_counts(found, buckets), _counts(wanted, buckets)))
    width, kind = _width(buckets), found.schema[key].dataType

    def weighed(batches):
        for batch in batches:
            weights = [int(gain.value[np.cumsum(np.frombuffer(b.as_py(), width), dtype=np.int64)].sum()) for b in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weights, pa.int64())], names=[*batch.schema.names[:4], "weight"])

    schema = T.StructType([*found.schema.fields[:4], T.StructField("weight", T.LongType())])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = found.mapInArrow(weighed, schema).withColumn("score", F.col("weight") + noise)
    order = [(F.col("n_words") < least_words).cast("int"), F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features"), F.col("tid")]
    parts = common.written(scored.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    common.dropped(found)
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in parts.groupBy(part.alias("part")).agg(F.count("*"), F.sum((F.col("n_words") >= least_words).cast("long"))).collect())  # one row a part
    draw, before, offsets = percent * sum(n for _, _, n in sizes) // 100, 0, []
    for p, n, _ in sizes:
        offsets.append((p, before))
        before += n
    first = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return parts.withColumn("part", part).join(first, "part", "left").select(key, "tid", "n_words", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))


def drawn(docs: DataFrame, ranked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that `resample` drew, whole, in no order; of repeated rows as many as were drawn."""
    kept = ranked.where("rank IS NOT NULL").groupBy(F.col(key).alias("_key"), F.col("tid").alias("_tid")).agg(F.count("*").alias("_n"))
    some = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("_own"), F.xxhash64(F.col(text).cast("string")).alias("_hash"))
    some = some.join(kept, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_tid")))
    some = some.withColumn("_i", F.row_number().over(Window.partitionBy("_own", "_hash").orderBy(F.lit(0))))
    return some.where("_i <= _n").select("row.*")
