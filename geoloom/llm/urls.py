"""URL filters over a sorted digest array.

The rules' keys (host/path prefixes) are held as ascending 64-bit xxhash digests beside their full strings, in shards by
range of digest. Spark packs the shards, each in one task, and ships their files to each executor, where tasks map them
into memory, so workers of a machine share one copy and a list of any size costs the driver nothing but file names. A URL
is probed with every key that could fit it, by one vectorised binary search for a whole batch in each shard, and a digest
that is found only counts if the stored string equals the probe.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Keys of a shard, about.
SHARD_KEYS = 1 << 20
#: Ends a key that fits the whole path before it only, and no longer one.
WHOLE = "\0"
#: Labelled texts that marker words are learned from, about; texts of the marked kind that hold a marker at least, and
#: their least share among all that hold it; pages of a host, and their share, from which the whole host is listed.
LEARNED_FROM, LEAST_TEXTS, LEAST_SHARE, HOST_PAGES, HOST_SHARE = 8000, 8, 0.9, 20, 0.5


def _digests(keys: list[str]) -> np.ndarray:
    """The digests that Spark's xxhash64 gives."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))


def _shard_of(digests: np.ndarray, shards: int) -> np.ndarray:
    return ((digests >> np.uint64(1)).astype(np.float64) / 2.0**63 * shards).astype(np.int64).clip(0, max(0, shards - 1))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host lower-cased (A-Z), both empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host) if not host.islower() else host, rest[:end]


def _suffixes(host: str) -> list[str]:
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        if at + 1 < len(host):
            out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def _probes(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every key that could fit, longest first; a longer host before a longer path."""
    tails = [path[:n] for n in lengths if 0 <= n <= len(path)]
    out = sorted((h + "/" + t[1:] if t else h for h in _suffixes(host) for t in tails if not t or t[0] == "/"), key=lambda k: (-len(k), -(k.find("/") if "/" in k else len(k))))
    return [host + path + WHOLE, *out] if lengths and lengths[0] < 0 and host else out


_PARTS = ("digests", "starts", "strings", "kinds")


def packed(keys: list[str], kinds: list[int]) -> dict[str, np.ndarray]:
    """A shard: digests ascending, where each string begins, the strings, and kinds (2 * layer, and 1 for block).

    A key that several layers have comes with its kinds ascending, so the first layer's is found first.
    """
    digests = _digests(keys)
    order = np.lexsort((np.array(kinds), digests))
    raw = [keys[i].encode() for i in order]
    return {"digests": digests[order], "starts": np.cumsum([0, *map(len, raw)]).astype(np.int64), "strings": np.frombuffer(b"".join(raw), np.uint8), "kinds": np.array([kinds[i] for i in order], np.int16)}


def _pack(key, rows):
    parts = packed(rows.column("key").to_pylist(), rows.column("kind").to_pylist())
    return pa.table({"shard": rows.column("shard").slice(0, 1), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()}})


class Shard:
    """The mapped arrays of a shard in a folder."""

    def __init__(self, folder: str):
        self.digests, self.starts, self.strings, self.kinds = (np.load(os.path.join(folder, f"{x}.npy"), mmap_mode="r") for x in _PARTS)

    def find(self, keys: list[str], digests: np.ndarray) -> np.ndarray:
        """The kind of each key, or -1."""
        at, out = np.searchsorted(self.digests, digests), np.full(len(keys), -1)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests) if len(self.digests) else ():
            key, j = keys[i].encode(), int(at[i])
            while j < len(self.digests) and self.digests[j] == digests[i]:
                if self.strings[self.starts[j] : self.starts[j + 1]].tobytes() == key:
                    out[i] = self.kinds[j] if out[i] < 0 else min(out[i], self.kinds[j])
                j += 1
        return out


def _mapped(file: str) -> dict[int, str]:
    """The folders with the arrays of a shipped file's shards; the first worker of a machine that asks unpacks them."""
    folder = f"{file}.arrays"
    if not os.path.isdir(folder):
        new = tempfile.mkdtemp(dir=os.path.dirname(file))
        table = pq.read_table(file)
        for row in range(table.num_rows):
            own = os.path.join(new, str(table.column("shard")[row].as_py()))
            os.mkdir(own)
            for part, kind in zip(_PARTS, (np.uint64, np.int64, np.uint8, np.int16)):
                np.save(os.path.join(own, f"{part}.npy"), np.frombuffer(table.column(part)[row].as_py(), kind))
        try:
            os.rename(new, folder)
        except OSError:  # another worker was first
            shutil.rmtree(new)
    return {int(x): os.path.join(folder, x) for x in os.listdir(folder)}


class Index:
    """All shards of an index by the files that Spark ships; a shard is opened when a probe falls into it."""

    def __init__(self, files: list[str], shards: int):
        self.files, self.shards, self.folders, self.opened = files, shards, None, {}

    def find(self, keys: list[str]) -> np.ndarray:
        """The kind of each key, or -1."""
        out = np.full(len(keys), -1)
        if not self.shards or not keys:
            return out
        if self.folders is None:
            self.folders = {k: v for x in self.files for k, v in _mapped(SparkFiles.get(x)).items()}
        digests = _digests(keys)
        shard = _shard_of(digests, self.shards)
        for k in np.unique(shard).tolist():
            if k in self.folders:
                mine = np.flatnonzero(shard == k)
                self.opened.setdefault(k, None)
                self.opened[k] = self.opened[k] or Shard(self.folders[k])
                out[mine] = self.opened[k].find([keys[i] for i in mine], digests[mine])
        return out


def ship(rules: DataFrame) -> tuple[Index, list[int]]:
    """Pack rules (layer, key, verdict) into shards and have Spark hand their files to every executor, also to those that
    join later; and the distinct lengths of the rules' paths."""
    spark = rules.sparkSession
    once = rules.where("key is not null").groupBy("layer", "key").agg(F.max("verdict").alias("verdict"))
    once = common.written(once.withColumn("kind", (2 * F.col("layer") + F.when(F.col("verdict") == "block", 1).otherwise(0)).cast("int")))
    slash = F.instr("key", "/")
    length = F.when(F.col("key").endswith(WHOLE), -1).when(slash > 0, F.length("key") - slash + 1).otherwise(0)
    lengths = sorted(r[0] for r in once.select(length.alias("n")).distinct().collect())
    shards = -(-once.count() // SHARD_KEYS)
    if not shards:
        return Index([], 0), lengths
    part = F.floor(F.shiftrightunsigned(F.xxhash64("key"), 1) / F.lit(2.0**63) * shards)
    placed = once.select(F.least(part, F.lit(shards - 1)).cast("int").alias("shard"), "key", "kind")
    table = common.written(placed.groupBy("shard").applyInArrow(_pack, "shard int, digests binary, starts binary, strings binary, kinds binary"), "none")
    common.dropped(once)
    files = sorted(table.select("_metadata.file_path").distinct().toPandas()["file_path"])
    for file in files:
        spark.sparkContext.addFile(file)
    return Index([os.path.basename(x) for x in files], shards), lengths


def _judged(index: Index, lengths: list[int]):
    def judged(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            probes = [_probes(*x, lengths) for x in parts]
            flat = [k for x in probes for k in x]
            kinds, at = index.find(flat), 0
            fit, verdict, layer = [], [], []
            for x in probes:
                found = [(int(k) // 2, j) for j, k in enumerate(kinds[at : at + len(x)]) if k >= 0]
                first = min(found, default=None)  # the earliest layer, in it the longest key
                fit.append(first and x[first[1]])
                layer.append(first and first[0])
                verdict.append("block" if first and kinds[at + first[1]] % 2 else "allow")
                at += len(x)
            hosts, paths = zip(*parts) if parts else ((), ())
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            new = [pa.array(x, pa.string()) for x in (hosts, paths, fit, verdict)]
            yield pa.RecordBatch.from_arrays([*own, *new, pa.array(layer, pa.int32())], [*batch.schema.names[:-1], "host", "path", "fit", "verdict", "layer"])

    return judged


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The verdict on each url: a row (key, host, path, fit, verdict, layer) for each row of pages.

    rules: (layer, key, verdict), of any number: a host/path prefix or a bare host, allow or block, in layers from 0 on;
    a later layer only judges what no rule of an earlier one fits. A rule fits its host and all subdomains if the path
    starts with the rule's; a bare host fits every path; a key that ends in `WHOLE` fits its own host and the path before
    that, both whole. The longest key that fits wins (of equal ones that with the
    longer host); a key with several verdicts in a layer blocks; a null key is no rule. fit is that key and layer its
    number, or both are null and the verdict is allow. Host: after the first :// up to / ? # or the end, A-Z
    lower-cased; path: from there up to ? # or the end; null urls, empty ones and urls without :// have neither and are
    allowed. A very long url costs a probe for each label of its host and length of a rule's path. Repeated rows and
    null keys are like any others; other columns are ignored, also such that bear the result's names; an empty table of
    pages gives an empty result, one of rules allows all. One pass over pages, no shuffle of them.
    """
    common.bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("did"), F.col(url).alias("url"))
    kind = dict(rows.dtypes)["did"]
    out = rows.mapInArrow(_judged(*ship(rules)), f"did {kind}, host string, path string, fit string, verdict string, layer int")
    return out.withColumnRenamed("did", key)


def host_of(url: str = "url") -> F.Column:
    """The host of a url as a column: lower-cased after the first ://, or null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.nullif(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: str = "url") -> F.Column:
    """The path of a url as a column: after the host, up to ? or #; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def words_of(text: str) -> F.Column:
    """The distinct words of a text, A to Z lower-cased; null for a null text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_distinct(F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))


def marker_words(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", learned_from: int = LEARNED_FROM, least: int = LEAST_TEXTS, share: float = LEAST_SHARE) -> DataFrame:
    """(word): the words that texts of a labelled kind hold and hardly any other text does.

    About `learned_from` labelled rows are drawn by a hash of the key, whatever the table; a marker is in at least
    `least` of the labelled texts, and at least `share` of the drawn texts that hold it have the label. Null texts hold
    nothing.
    """
    n = max(1, labels.count())
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("url:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long")
    some = labels.where(h < (learned_from << 32) // n).select(F.col(key).alias("id"), (F.col(label) == 1).alias("marked"))
    held = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(common.small_side(some, 4 * learned_from), "id")
    counts = held.select("marked", F.explode(words_of("text")).alias("word")).groupBy("word").agg(F.count_if("marked").alias("a"), F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("a") >= least) & (F.col("a") >= share * F.col("n"))).select("word")


def listed_pages(pages: DataFrame, markers: DataFrame, url: str = "url", html: str = "html", host_pages: int = HOST_PAGES, host_share: float = HOST_SHARE) -> DataFrame:
    """(key, verdict): what the contents of pages say is to be blocked.

    A page with a marker word lists its own host and path, whole; a host of at least `host_pages` pages, of which at
    least `host_share` are listed, is listed itself. Pages without a host list nothing.
    """
    rows = pages.select(host_of(url).alias("host"), path_of(url).alias("path"), F.col(html).alias("html")).where("host is not null")
    words = rows.select("host", "path", F.explode(words_of("html")).alias("word"))
    hit = words.join(common.small_side(common.written(markers), 100_000), "word", "left_semi").select("host", "path").distinct()
    hit = common.written(hit)
    own = hit.select(F.concat("host", "path", F.lit(WHOLE)).alias("key"))
    each = rows.select("host", "path").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(hit.withColumn("hit", F.lit(True)), ["host", "path"], "left")
    hosts = each.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    whole = hosts.where((F.col("n") >= host_pages) & (F.col("hits") >= host_share * F.col("n"))).select(F.col("host").alias("key"))
    return own.unionByName(whole).withColumn("verdict", F.lit("block"))
