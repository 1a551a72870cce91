"""Mixing sources to target weights: whole passes, then a subset of documents whose sizes add up to the rest.

Each source has a word target. It takes every document as often as the target allows in whole passes; what remains
is a subset-sum problem over the source's sizes. Documents are counted by exact size, most of the budget is shared
out in proportion to these counts, and a bounded knapsack over the counts that are left fits the remainder. Which
documents of a size are taken is decided by a seeded hash, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The part of a remainder that the knapsack solves exactly, in words; what is above is taken greedily.
KNAPSACK_WORDS = 1 << 16
#: Documents of one source and size that are ranked together.
RANKED_TOGETHER = 1000

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _sizes(batches):
    for batch in batches:
        raw, at = common.texts(batch.column("text"))
        word = _IS_WORD[np.frombuffer(raw, np.uint8)]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        first = at[:-1][at[:-1] < at[1:]]
        begins[first] = word[first]
        upto = np.zeros(len(word) + 1, np.int64)
        np.cumsum(begins, out=upto[1:])
        yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("src"), batch.column("tag"), pa.array(upto[at[1:]] - upto[at[:-1]])], ["did", "src", "tag", "size"])


def fitted(sizes: list[int], counts: list[int], budget: int, most: int = KNAPSACK_WORDS) -> list[int]:
    """How many to take of each size so that the words come as near below the budget as the sizes allow."""
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    share = [c * budget // total for c in counts]
    rest = budget - sum(s * n for s, n in zip(sizes, share))
    for i in sorted(range(len(sizes)), key=lambda i: (-(counts[i] * budget % total), sizes[i])):
        if rest <= most:
            break
        more = min(1, counts[i] - share[i], max(0, rest - most // 2) // sizes[i] if sizes[i] <= most else rest // sizes[i])
        share[i] += more
        rest -= more * sizes[i]
    items = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        left, step = min(counts[i] - share[i], rest // sizes[i]), 1
        while left > 0:
            items.append((i, n := min(step, left)))
            left, step = left - n, step * 2
    full, reach, states = (1 << (rest + 1)) - 1, 1, [1]
    for i, n in items:
        reach |= (reach << (n * sizes[i])) & full
        states.append(reach)
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for k in range(len(states) - 1, 0, -1):
        if not states[k - 1] >> at & 1:
            i, n = items[k - 1]
            share[i] += n
            at -= n * sizes[i]
    return share


def _planned(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    total, target = int(rows["source_size"].iloc[0]), round(float(rows["target"].iloc[0]))
    rows["passes"] = passes = target // total
    rows["extra"] = fitted(rows["size"].tolist(), rows["n"].tolist(), target - passes * total) if target > passes * total else 0
    return rows[["src", "size", "n", "source_size", "target", "passes", "extra"]]


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with each source's place in code point order: places within parts of the order, after the parts before."""
    parts = max(1, min(common.partitions(sizes.sparkSession), -(-sizes.count() // 10_000)))
    ordered = common.written(sizes.repartitionByRange(parts, "src").withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("src"))
    return ordered.withColumn("place", place).join(F.broadcast(counts.select("part", "before")), "part").select("src", "source_size", (F.col("place") + F.col("before")).alias("place"))


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """(src, source_size, target) from (src, source_size): the word target of each source.

    Sources in code point order, null last, get the weights in turn and share so much of all words by weight;
    a target stops at `most` times its source's size and the excess is shared again, until none is above. Only sums
    over all sources are gathered, so there may be as many sources as there are hosts. The sums are of whole numbers,
    so reruns agree to the last digit.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    w = common.written(_numbered(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    budget = (w.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level = 0.0
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        full, free = w.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        after = (budget - (full or 0)) / free if free else level
        if not free or after <= level:
            break
        level = after
    return w.select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each document goes into a mix whose sources come near their word targets.

    Returns a row for each row of docs: key, size (words, runs of other characters than space and \\t to \\r; null
    and empty texts have none), source_size (words of its source), target (its source's, in words; see `targets`),
    repeats (0 to `most`), taken (size * repeats). A null source is a source of its own, the last. Documents of
    equal size are told apart by a seeded hash of the key; rows with the same key and size are as good as each
    other. A source without words has target 0. An empty table gives an empty result; other columns are ignored. key
    holds whole numbers (or text that reads as such).
    """
    found = _mixed(docs, weights, share, most, seed, key, text, source, F.lit(None).cast("string"))
    return found.withColumnRenamed("did", key).drop("tag")


def take(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, whole, with size, source_size, target, repeats and taken of `mix` beside them.

    A row of docs that the mix leaves out is absent; one that it takes comes once, with its number of repeats. Rows are
    told apart by a SHA-256 of all their columns, so keys may be null or repeat; of equal rows as many come as the mix
    takes. Columns of docs that bear one of the five names are replaced. Nulls, empty texts and empty tables as in `mix`.
    """
    names = ["size", "source_size", "target", "repeats", "taken"]
    own = [c for c in docs.columns if c not in names or c in (key, text, source)]
    marked = docs.select(*(F.col(f"`{c}`") for c in own), F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in own))), 256).alias("_tag"))
    found = _mixed(marked, weights, share, most, seed, key, text, source, F.col("_tag")).where("repeats > 0")
    kinds = common.written(found.groupBy(F.col("tag").alias("_tag"), *names).agg(F.count(F.lit(1)).alias("_rows")))
    planned = kinds.join(kinds.groupBy("_tag").agg(F.sum("_rows").alias("_of")), "_tag")
    columns = [*(F.col(f"`{c}`") for c in own), *names]
    single = marked.join(planned.where("_of = 1"), "_tag").select(*columns)
    again = planned.where("_of > 1")
    copies = marked.join(again.select("_tag").distinct(), "_tag", "left_semi").dropDuplicates(["_tag"]).join(again, "_tag")
    return single.unionByName(copies.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).select(*columns))


def _mixed(docs: DataFrame, weights, share: float, most: int, seed: int, key: str, text: str, source: str, tag) -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    marked = F.when(F.col(source).isNotNull(), F.concat(F.lit("s"), F.col(source))).otherwise("t")
    rows = docs.select(F.col(key).cast("long").alias("did"), marked.alias("src"), tag.alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = common.written(rows.mapInArrow(_sizes, "did long, src string, tag string, size long"))
    counts = sized.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = common.written(targets(counts.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    plan = counts.where("size > 0").join(totals, "src").groupBy("src").applyInPandas(_planned, "src string, size long, n long, source_size long, target double, passes long, extra long")
    plan = common.written(plan)

    order = F.xxhash64(F.lit(seed), F.col("did"))
    some = sized.join(plan, ["src", "size"]).select("did", "tag", "src", "size", "source_size", "target", "passes", "extra", "n", order.alias("h"))
    some = some.withColumn("part", F.pmod("h", F.ceil(F.col("n") / RANKED_TOGETHER)))
    whole = some.where("extra = 0 or extra = n").withColumn("repeats", F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0))
    cut = some.where("extra > 0 and extra < n")
    keys = ["src", "size", "part"]
    upto = Window.partitionBy("src", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*keys, "extra").agg(F.count(F.lit(1)).alias("here")).withColumn("quota", F.col("extra") - F.coalesce(F.sum("here").over(upto), F.lit(0)))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "did", "tag")))
    ranked = ranked.join(parts.select(*keys, "quota"), keys).withColumn("repeats", F.col("passes") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0))
    empty = sized.where("size = 0").join(totals, "src").withColumn("repeats", F.lit(0).cast("long"))
    columns = ["did", "tag", "size", "source_size", "target", F.col("repeats").cast("long").alias("repeats"), (F.col("size") * F.col("repeats")).cast("long").alias("taken")]
    out = whole.select(*columns)
    for x in (ranked, empty):
        out = out.unionByName(x.select(*columns))
    return out
