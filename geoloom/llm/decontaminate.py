"""Benchmark decontamination: every test suffix is looked up in suffix arrays of the training texts.

A shard is a run of training texts within one task. Its suffix array holds the word positions whose words stay within
the benchmark's word pairs for long enough to matter (no other suffix can match), sorted by their leading words. Each
suffix of each test item is binary-searched in it, and what is found is extended to its longest verbatim match.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

#: Windows of item texts in a block that is sent to the executors; a larger benchmark is looked up block after block.
MOST_SENT = 1_000_000

#: Lower-cases A-Z; all of ASCII that is no digit or letter becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Tests:
    """The suffixes of a block of test items: their leading words as numbers, and where each one comes from."""

    def __init__(self, items: list[tuple[str, str | None]], length: int):
        words = [(i, words_of((t or "").encode())) for i, t in items]
        words = [(i, w) for i, w in words if w]
        self.numbers = {w: n for n, w in enumerate(sorted({w for _, ws in words for w in ws}), 1)}
        self.ids = [i for i, _ in words]
        self.items = [np.array([self.numbers[w] for w in ws], np.int64) for _, ws in words]
        self.length = length
        self.least = min((min(length, len(x)) for x in self.items), default=length)
        size = len(self.numbers) + 1
        pairs = [x[:-1] * size + x[1:] for x in self.items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        keys, item, place = [], [], []
        width = 4 * length
        for k, x in enumerate(self.items):
            n = min(length, len(x))
            rows = np.zeros((len(x) - n + 1, length), ">u4")
            rows[:, :n] = np.lib.stride_tricks.sliding_window_view(x, n)
            keys.append(np.ascontiguousarray(rows).view(f"S{width}").ravel())
            item.append(np.full(len(rows), k, np.int32))
            place.append(np.arange(len(rows), dtype=np.int32))
        keys = np.concatenate(keys) if keys else np.zeros(0, f"S{width}")
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        #: Where each distinct window begins among all of them, and of each the item and the place in it.
        self.begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.ends = np.r_[self.begins[1:], len(keys)].astype(np.int64)
        self.item, self.place = (np.concatenate(x)[order] if x else np.zeros(0, np.int32) for x in (item, place))
        self.low = keys[self.begins]
        self.sizes = np.array([-(-len(k) // 4) for k in self.low.tolist()], np.int64)
        high = self.low.copy().view(np.uint8).reshape(-1, width)
        high[np.arange(width) >= 4 * self.sizes[:, None]] = 255
        self.high = high.view(f"S{width}").ravel()


def _shard(words: list[list[bytes]], tests: Tests):
    """Per text: which words are hit, the items found, and the longest match of each with its places."""
    get = tests.numbers.get
    size = np.array([len(w) for w in words])
    begin = np.cumsum(np.r_[0, size[:-1] + 1])  # each text is followed by a 0, which no item has
    ids = np.zeros(int((size + 1).sum()) + tests.length, np.int64)
    for b, w in zip(begin.tolist(), words):
        ids[b : b + len(w)] = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
    hit, found = np.zeros(len(ids) + 1, np.int32), {}
    if not len(tests.low):
        return hit, begin, found
    pair = np.isin(ids[:-1] * (len(tests.numbers) + 1) + ids[1:], tests.pairs) if tests.least > 1 else ids[:-1] > 0
    need = max(1, tests.least - 1)
    upto = np.r_[0, np.cumsum(pair)]
    at = np.flatnonzero(upto[need:] - upto[:-need] == need)
    at = at[at + tests.length <= len(ids)]
    keys = ids[at[:, None] + np.arange(tests.length)]
    keys[np.cumsum(keys == 0, axis=1) > 0] = 0
    keys = np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * tests.length}").ravel() if len(at) else np.zeros(0, f"S{4 * tests.length}")
    order = np.argsort(keys, kind="stable")
    suffixes, keys = at[order], keys[order]
    first, last = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
    for k in np.flatnonzero(last > first):
        n, spread = int(tests.sizes[k]), slice(tests.begins[k], tests.ends[k])
        places = list(zip(tests.item[spread].tolist(), tests.place[spread].tolist()))
        for p in suffixes[first[k] : last[k]].tolist():
            hit[p] += 1
            hit[p + n] -= 1
            doc = int(np.searchsorted(begin, p, "right")) - 1
            best = found.setdefault(doc, {})
            for item, j in places:
                held = best.get(item)
                if held and held[0] <= p - begin[doc] and p - begin[doc] - held[0] == j - held[1] and p - begin[doc] + n <= held[0] + held[2]:
                    continue  # within a match that was extended already
                x, m, i = tests.items[item], n, p
                while j + m < len(x) and ids[i + m] == x[j + m]:
                    m += 1
                back = 0
                while back < min(j, i - begin[doc]) and ids[i - back - 1] == x[j - back - 1]:
                    back += 1
                if not held or m + back > held[2]:
                    best[item] = (int(p - back - begin[doc]), j - back, m + back)
    return hit, begin, found


_MATCH = pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())])
_MATCHES = "array<struct<item_id:string,start:long,item_start:long,words:long>>"


def _looked_up(block, length: int):
    """Look a block up; mask has a bit for each word that is hit so far, matches the longest match of each item found."""

    def looked_up(batches):
        tests = Tests(block.value, length)
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            earlier = list(zip(batch.column("mask"), batch.column("matches"))) if "mask" in batch.schema.names else None
            out = []
            for i, j in windows.chunks(batch):
                words = [words_of(bytes(raw[at[k] : at[k + 1]])) for k in range(i, j)]
                total, begin, found = _shard(words, tests)
                covered = np.cumsum(total) > 0
                for k, w in enumerate(words):
                    mine = covered[begin[k] : begin[k] + len(w)]
                    matches = {tests.ids[item]: m for item, m in found.get(k, {}).items()}
                    if earlier:
                        mask, held = earlier[i + k]
                        mine = mine | np.unpackbits(np.frombuffer(mask.as_py(), np.uint8), count=len(w)).astype(bool)
                        matches |= {m["item_id"]: (m["start"], m["item_start"], m["words"]) for m in held.as_py()}
                    ids = sorted(matches)
                    listed = [dict(zip(("item_id", "start", "item_start", "words"), (x, *matches[x]))) for x in ids]
                    out.append((len(w), int(mine.sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), np.packbits(mine).tobytes(), listed))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(_MATCH)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["row", "text", "n_words", "n_hit", "n_items", "items_sha256", "mask", "matches"])

    return looked_up


def _items(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    """(block, i, t) of the items, dealt by a hash of the id into blocks of about MOST_SENT words at most, and how many."""
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null")
    n_words = F.size(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    n = max(1, -(-(items.agg(F.sum(n_words)).first()[0] or 0) // MOST_SENT))
    return items.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(n))), n


def find_overlap(docs: DataFrame, benchmark: DataFrame, length: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Where texts hold benchmark items verbatim: a row for each row of docs.

    Words are runs of digits, letters (A-Z lower-cased) and all beyond ASCII. A window is `length` consecutive words of
    an item, or a shorter item as a whole. Returns key, n_words, n_hit (words inside any occurrence of a window),
    n_items (items with occurring windows), items_sha256 (of their ids, sorted as strings, comma-joined), matches (for
    each such item its longest verbatim match: item_id, start and item_start in words, words) and contaminated.
    A null or empty text has no words; items without words or with a null id are none; items that repeat count once by
    id. Repeated rows, null keys and very long texts are like any others; other columns are ignored, also such that bear
    the result's names; an empty table of docs gives an empty result, one of items no hits. One pass over docs for each
    block of the benchmark, no shuffle; one block is in memory at a time, in the driver and in a task.
    """
    found = _found(docs.select(F.struct(F.col(key).alias("did")).alias("row"), F.col(text).alias("text")), benchmark, length, item, item_text)
    return found.select(F.col("row.did").alias(key), "n_words", "n_hit", "n_items", "items_sha256", "matches", (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, same columns, without the rows that hold a window of a benchmark item."""
    found = _found(common.apart(docs, text), benchmark, length, item, item_text)
    return common.together(found.where("n_hit = 0"), docs.columns, text)


def _found(rows: DataFrame, benchmark: DataFrame, length: int, item: str, item_text: str) -> DataFrame:
    spark = rows.sparkSession
    common.bounded_batches(spark)
    out = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_words long, n_hit long, n_items long, items_sha256 string, mask binary, matches {_MATCHES}"
    items, n = _items(benchmark, item, item_text)
    for b in range(n):
        block = spark.sparkContext.broadcast([tuple(r) for r in items.where(F.col("block") == b).select("i", "t").collect()])
        found = rows.mapInArrow(_looked_up(block, length), out)
        if b == n - 1:
            return found
        # the next block is looked up in what this one leaves; then neither it nor the table before is needed
        before, rows = rows, common.written(found.select("row", "text", "mask", "matches"))
        common.dropped(before)
        block.destroy()
