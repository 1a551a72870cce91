"""Joining texts by the Jaccard similarity of their word n-grams, by chosen paths.

Texts with one n-gram set are a class. Each class gets a signature of min-hashes, its sampled tokens. A run starts
with all classes in one node; a node that is too large to compare splits into children, one for each value of two
coordinates that the node's path chooses, so classes follow the tokens they share. Nodes that are small enough are
compared as a whole by signature. A pair at the threshold is lost in one run with a probability that follows from the
number of coordinates (`lost_in`); runs are repeated until what is lost is below the target.

A large node that does not shrink is a group of near copies: it becomes one candidate group instead of splitting
on. Every candidate group is then compared exactly, on whole n-gram sets: small ones in one task, large ones block by
block. In a large group each set is held as its difference from the set of one of its classes, which for near copies is
a few n-grams, and only blocks of neighbouring size bands meet; no text goes into a block. No pairs are written, only
each class's number of links and links to one neighbour.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, windows

#: Coordinates of a signature; coordinates that a node splits on; levels of splitting at most.
SIGNATURE, SPLITS, LEVELS = 64, 2, 10
#: Classes of a node that are compared at once; a child with more than this share of its node did not shrink.
SMALL, DENSE = 200, 0.5
#: Share of pairs at the threshold that may be lost by splitting.
LOST = 1e-4
#: Standard errors by which the signatures' estimate may lie below the threshold.
ERRORS = 4.0
#: Classes of a candidate group that one task compares with each other; of a larger group, blocks of so many.
BLOCK = 1024
#: Bytes of the texts that large groups are held against, up to which they are sent to every task.
MOST_CENTRES = 16 << 20


def lost_in_a_run(similarity: float) -> float:
    """The chance that a pair of a similarity meets in no small node of a run, however deep."""
    lost = 0.0
    for _ in range(LEVELS):
        lost = (1 - similarity * (1 - lost)) ** SPLITS
    return lost


def lost_in(runs: int, similarity: float) -> float:
    """The chance that a pair of a similarity meets in no small node of any run.

    All runs split on the same coordinates, so a pair that agrees on few of them is lost in each more often: the chance
    is the expectation over how many agree.
    """
    agree = np.arange(SIGNATURE + 1)
    logs = np.array([math.lgamma(SIGNATURE + 1) - math.lgamma(k + 1) - math.lgamma(SIGNATURE - k + 1) for k in agree.tolist()])
    chance = np.exp(logs + agree * math.log(similarity) + (SIGNATURE - agree) * math.log1p(-similarity)) if 0 < similarity < 1 else (agree == SIGNATURE).astype(float)
    return float(sum(c * lost_in_a_run(k / SIGNATURE) ** runs for k, c in zip(agree.tolist(), chance)))


def runs_for(similarity: float, lost: float = LOST) -> int:
    """Runs until at most such a share of the pairs at the threshold is lost by splitting."""
    return next(r for r in range(1, 1000) if lost_in(r, similarity) <= lost or r == 999)


_RANDOM = windows._mixed(np.arange(1, 2 * SIGNATURE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_TIMES, _PLUS = _RANDOM[:SIGNATURE] | np.uint64(1), _RANDOM[SIGNATURE:]


def shingles(text: bytes, n: int, kept: windows.Values) -> np.ndarray:
    """The text's distinct word n-grams as ascending hashes; a text with fewer words is one n-gram."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    return np.unique(windows.fingerprints(values, n, np.arange(len(words) - n + 1)) ^ np.uint64(n))


def _signed(n: int):
    def signed(batches):
        import xxhash

        kept = windows.Values()
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            cid, size, sketch = [], [], []
            for k in range(batch.num_rows):
                s = shingles(bytes(raw[at[k] : at[k + 1]]), n, kept)
                size.append(len(s))
                if not len(s):
                    cid.append(None)
                    sketch.append(None)
                    continue
                cid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                low = np.full(SIGNATURE, ~np.uint64(0))
                for i in range(0, len(s), 2048):
                    np.minimum(low, (s[i : i + 2048, None] * _TIMES + _PLUS).min(axis=0), out=low)
                sketch.append((low >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(cid, pa.int64()), pa.array(size, pa.int64()), pa.array(sketch, pa.binary())], ["did", "cid", "n", "sketch"])

    return signed


def _split(nodes: DataFrame, level: int) -> DataFrame:
    """Children of nodes (node, of, cid, sketch): a row for each coordinate that the node's path chooses."""
    way = F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))
    rows = nodes.withColumn("way", way).withColumn("at", F.pmod(F.xxhash64("node", "way", F.lit(level)), F.lit(SIGNATURE)).cast("int"))
    return rows.select(F.xxhash64("node", "way", "at", F.expr("substring(sketch, at * 4 + 1, 4)")).alias("node"), F.col("of"), "cid")


def _groups(alike: np.ndarray) -> np.ndarray:
    """The smallest index of each row's component."""
    n = len(alike)
    labels = np.arange(n)
    while True:
        low = np.minimum(labels, np.where(alike, labels[None, :], n).min(axis=1))
        low = low[low]
        if (low == labels).all():
            return labels
        labels = low


def _likely(least: int):
    """Within each node of a bin, links that make one tree of each group of classes with alike signatures."""

    def likely(key, rows):
        node, cid = (rows.column(x).to_numpy() for x in ("node", "cid"))
        order = np.argsort(node, kind="stable")
        node, cid = node[order], cid[order]
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint32).reshape(-1, SIGNATURE)[order]
        edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
        u, v = [], []
        for a, b in zip(edge[:-1], edge[1:]):
            s = sketch[a:b]
            alike = np.array([(s == x).sum(axis=1) >= least for x in s])
            labels = _groups(alike)
            other = np.flatnonzero(labels != np.arange(b - a))
            u.append(cid[a:b][labels[other]])
            v.append(cid[a:b][other])
        return pa.table({"u": np.concatenate(u) if u else np.zeros(0, np.int64), "v": np.concatenate(v) if v else np.zeros(0, np.int64)})

    return likely


def _candidates(reps: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) whose components hold every pair of classes that may be similar."""
    spark = reps.sparkSession
    level, links = 0, None
    nodes = reps.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs_for(similarity)).cast("long"))).alias("node"), F.lit(None).cast("long").alias("of"), "cid", "sketch")
    least = int(np.floor(SIGNATURE * similarity - ERRORS * np.sqrt(SIGNATURE * similarity * (1 - similarity))))
    small = None
    made = []
    while True:
        children = _split(nodes, level)
        sizes = common.written(children.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        # a node that very many classes are in never meets in one task
        flagged = children.join(common.hot(sizes, "n", sizes.agg(F.sum("n")).first()[0] or 0).withColumnRenamed("n", "hot"), "node", "left")
        rest = flagged.where("hot is null").drop("hot").join(sizes, "node")
        sized = common.written(rest.unionByName(flagged.where("hot is not null").withColumnRenamed("hot", "n")))
        common.dropped(sizes)
        made.append(sized)
        dense = (F.col("n") > SMALL) & ((F.col("of").isNotNull() & (F.col("n") > DENSE * F.col("of"))) | F.lit(level + 1 >= LEVELS))
        here = sized.where(F.col("n") <= SMALL).select("node", "cid")
        small = here if small is None else small.unionByName(here)
        crowd = sized.where(dense).select("node", "cid")
        center = common.small_side(crowd.groupBy("node").agg(F.min("cid").alias("u")), 100_000)  # at most a row for SMALL classes
        star = crowd.join(center, "node").where("u != cid").select("u", F.col("cid").alias("v"))
        links = star if links is None else links.unionByName(star)
        large = sized.where((F.col("n") > SMALL) & ~dense)
        if large.isEmpty():
            break
        nodes = large.select("node", F.col("n").alias("of"), "cid").join(reps.select("cid", "sketch"), "cid")
        level += 1
    compared = small.join(reps.select("cid", "sketch"), "cid")
    bins = max(common.partitions(spark), small.count() // 20_000)
    likely = compared.groupBy(F.pmod("node", F.lit(bins)).alias("bin")).applyInArrow(_likely(least), "u long, v long")
    out = common.written(links.unionByName(likely).distinct())
    for x in made:
        common.dropped(x)
    return out


def _shared(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many n-grams each set of a shares with each set of b (None: of a)."""
    sets = a if b is None else a + b
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts[which] > 1  # an n-gram of one set is shared with none
    doc, which = doc[often], np.unique(which[often], return_inverse=True)[1]
    width, left = (int(which.max()) + 1 if len(which) else 0), len(a)
    right = slice(0, left) if b is None else slice(left, len(sets))
    out = np.zeros((left, len(sets[right])), np.float32)
    order = np.argsort(which, kind="stable")
    doc, which = doc[order], which[order]
    for lo in range(0, width, 4096):  # columns at a time, so that the matrix stays small
        i, j = np.searchsorted(which, (lo, lo + 4096))
        m = np.zeros((len(sets), min(4096, width - lo)), np.float32)
        m[doc[i:j], which[i:j] - lo] = 1
        out += m[:left] @ m[right].T
    return out.astype(np.int64)


def _differences(n: int):
    """Each class's n-grams that its group's centre lacks or that it lacks itself, and how many it lacks."""

    def differences(batches):
        kept, last, centre = windows.Values(), None, None
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            size, missing, diff = [], [], []
            for k, text in enumerate(batch.column("centre")):
                if last is None or text != last:
                    last, centre = text, shingles(text.as_py().encode(), n, kept)
                own = shingles(bytes(raw[at[k] : at[k + 1]]), n, kept)
                apart = np.setxor1d(own, centre, assume_unique=True)
                size.append(len(own))
                missing.append((len(centre) + len(apart) - len(own)) // 2)
                diff.append(apart.tobytes())
            columns = [batch.column(c) for c in ("label", "cid", "m")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(missing, pa.int64()), pa.array(diff, pa.binary())], ["label", "cid", "m", "n", "missing", "diff"])

    return differences


def _blocks(texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The classes of large groups, dealt to pairs of blocks: (part, side, cid, m, n, missing, diff).

    A band holds the sizes within a ratio somewhat below the similarity, so similar sets are in one band or in two next
    to each other. A block is a share of a band by hash; each block meets each of its own and of the next band.
    """
    spark = texts.sparkSession
    first = texts.groupBy("label").agg(F.min("cid").alias("cid"))
    centres = common.written(texts.select("cid", F.col("text").alias("centre")).join(first, "cid").select("label", "centre"))
    bytes_ = centres.agg(F.coalesce(F.sum(F.octet_length("centre")), F.lit(0))).first()[0]
    against = F.broadcast(centres) if bytes_ <= MOST_CENTRES else centres
    rows = texts.select("label", "cid", "m", "text").join(against, "label")
    found = common.written(rows.mapInArrow(_differences(n), "label long, cid long, m long, n long, missing long, diff binary"))
    common.dropped(centres)
    band = F.floor(F.ln(F.col("n").cast("double")) / -math.log(min(0.99, similarity - 0.01))).cast("int") if similarity > 0.02 else F.lit(0)
    found = found.withColumn("band", band)
    sizes = common.written(found.groupBy("label", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    near = lambda step, name: sizes.select("label", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    plan = sizes.join(near(1, "above"), ["label", "band"], "left").join(near(-1, "below"), ["label", "band"], "left")
    placed = found.join(common.small_side(common.written(plan), 100_000), ["label", "band"])
    block = F.pmod(F.xxhash64("cid", F.lit("block")), F.col("blocks")).cast("int")
    count = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    # own band: (low, high, side); the next one up and down: this block is the left or the right one
    own = F.transform(count("blocks"), lambda o: F.struct(F.col("band").alias("a"), F.lit(0).alias("step"), F.least("block", o).alias("low"), F.greatest("block", o).alias("high"), F.when(o == F.col("block"), 0).when(F.col("block") < o, 1).otherwise(2).alias("side")))
    up = F.transform(count("above"), lambda o: F.struct(F.col("band").alias("a"), F.lit(1).alias("step"), F.col("block").alias("low"), o.alias("high"), F.lit(1).alias("side")))
    down = F.transform(count("below"), lambda o: F.struct((F.col("band") - 1).alias("a"), F.lit(1).alias("step"), o.alias("low"), F.col("block").alias("high"), F.lit(2).alias("side")))
    dealt = placed.withColumn("block", block).withColumn("to", F.explode(F.concat(own, up, down)))
    return dealt.select(F.xxhash64("label", "to.a", "to.step", "to.low", "to.high").alias("part"), "to.side", "cid", "m", "n", "missing", "diff")


def _compared_blocks(similarity: float):
    """Links and groups within a block, or between two, of sets held as differences from one set."""

    def compared(key, rows):
        cid, m, side, size, missing = (rows.column(x).to_numpy() for x in ("cid", "m", "side", "n", "missing"))
        diff = [np.frombuffer(b.as_py(), np.uint64) for b in rows.column("diff")]
        left, right = (np.flatnonzero(side < 2), np.flatnonzero(side == 2)) if (side > 0).any() else (np.arange(len(cid)), None)
        out = {"cid": [], "label": [], "links": []}

        def add(which, labels, links):
            out["cid"].append(cid[which])
            out["label"].append(labels)
            out["links"].append(links)

        a = [diff[k] for k in left]
        b = None if right is None else [diff[k] for k in right]
        other = left if right is None else right
        if len(left) and len(other):
            # both lack what they lack of the centre, which counts twice where it is the same
            centre = size[left[0]] + missing[left[0]] - (len(diff[left[0]]) - missing[left[0]])
            shared = centre - missing[left][:, None] - missing[other][None, :] + _shared(a, b)
            alike = _similar(shared, size[left], size[other], similarity)
            if right is None:
                np.fill_diagonal(alike, False)
                add(left, cid[left][_groups(alike)], alike @ m[left])
            else:
                links = alike @ m[right], m[left] @ alike
                whole = np.zeros((len(left) + len(right),) * 2, bool)
                whole[: len(left), len(left) :] = alike
                labels = np.r_[cid[left], cid[right]][_groups(whole | whole.T)]
                add(left, labels[: len(left)], links[0])
                add(right, labels[len(left) :], links[1])
        else:
            add(np.arange(len(cid)), cid, np.zeros(len(cid), np.int64))
        return pa.table({"cid": np.concatenate(out["cid"]), "label": np.concatenate(out["label"]), "links": np.concatenate(out["links"]).astype(np.int64)})

    return compared


def _similar(shared: np.ndarray, sizes, others, similarity: float) -> np.ndarray:
    """Whether shared / union reaches the similarity, in whole numbers."""
    parts = round(similarity * 10**6)
    union = np.asarray(sizes)[:, None] + np.asarray(others)[None, :] - shared
    return (shared * 10**6 >= parts * union) & (shared > 0)


def _compared(n: int, similarity: float):
    """Links and groups within each candidate group of a bin."""

    def compared(key, rows):
        part, cid, m = (rows.column(x).to_numpy() for x in ("part", "cid", "m"))
        raw, at = common.texts(rows.column("text"))
        kept = windows.Values()
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True])
        out_cid, out_label, out_links = [], [], []
        for lo, hi in zip(edge[:-1], edge[1:]):
            mine = order[lo:hi]
            sets = [shingles(bytes(raw[at[k] : at[k + 1]]), n, kept) for k in mine]
            sizes, weight = np.array([len(s) for s in sets]), m[mine]
            alike = _similar(_shared(sets, None), sizes, sizes, similarity)
            np.fill_diagonal(alike, False)
            labels = _groups(alike)
            out_cid.append(cid[mine])
            out_label.append(cid[mine][labels])
            out_links.append(alike @ weight)
        return pa.table({"cid": np.concatenate(out_cid), "label": np.concatenate(out_label), "links": np.concatenate(out_links).astype(np.int64)})

    return compared


def similar(docs: DataFrame, n: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The near-duplicate group and the links of each text: a row (key, class_id, n_links, n_copies, tid) for each row of docs.

    Two rows are linked if the Jaccard similarity of their sets of n consecutive words is at least `similarity`; a text
    with fewer words is one such n-gram. Words are runs of other characters than space and \\t to \\r. class_id is the
    smallest key of the rows that links connect; n_links the number of other rows linked to this one, copies among
    them counted; n_copies the rows with the same set; tid a hash of the text. A text without words (null or empty) is
    linked to nothing and its class is its own key. Rows that repeat, also with one key, are copies of each
    other; a null key never names a class that has another. Other columns are ignored; an empty table gives an empty
    result. Sets and n-grams are told apart by 64-bit hashes. key holds whole numbers (or text that reads as such).
    """
    return _grouped(docs, n, similarity, key, text).drop("label")


def _grouped(docs: DataFrame, n: int, similarity: float, key: str, text: str) -> DataFrame:
    """The rows of `similar` with the label of their group, which no other group has (null: a text without words)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("did"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.select(F.struct("did", F.xxhash64("text").alias("tid")).alias("did"), "text")
    signed = common.written(keyed.mapInArrow(_signed(n), "did struct<did:long,tid:long>, cid long, n long, sketch binary"))
    reps = common.written(signed.where("cid is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("did.tid").alias("tid")))
    candidates = _candidates(reps, similarity)
    group = common.written(components.components(candidates))
    common.dropped(candidates)

    of = group.groupBy("label").agg(F.count(F.lit(1)).alias("of"))
    member = group.withColumnRenamed("node", "cid").join(of, "label").join(reps.select("cid", "m", "n", "tid"), "cid")
    member = common.written(member)
    # a text of each class: the rows whose text the class is represented by, one of them if copies are alike
    first = signed.where("cid is not null").join(member.select("cid", F.col("tid").alias("mtid")), "cid").where("did.tid = mtid").groupBy("cid").agg(F.min("did.did").alias("did"), F.first("mtid").alias("tid"))
    with_tid = rows.withColumn("tid", F.xxhash64("text"))
    chosen = with_tid.join(first.select("tid", F.col("did").alias("fdid")), "tid").where(F.col("did").eqNullSafe(F.col("fdid"))).select("tid", "text")
    texts = member.join(chosen, "tid").select("cid", "label", "of", "m", "text")
    texts = common.written(texts.dropDuplicates(["cid"]))  # rows may repeat with key and text
    return _linked(spark, signed, reps, texts, n, similarity, key)


def _linked(spark, signed, reps, texts, n, similarity, key):
    out = "cid long, label long, links long"
    within = texts.where(F.col("of") <= BLOCK).select(F.col("label").alias("part"), "cid", "m", "text")
    bins = max(common.partitions(spark), texts.count() // 1000)
    alone = within.groupBy(F.pmod(F.xxhash64("part"), F.lit(bins)).alias("bin")).applyInArrow(_compared(n, similarity), out)
    across = _blocks(texts.where(F.col("of") > BLOCK).select("label", "cid", "m", "text"), n, similarity)
    blocked = common.written(across.groupBy("part").applyInArrow(_compared_blocks(similarity), out))
    joined = components.components(blocked.select(F.col("cid").alias("u"), F.col("label").alias("v")))
    links = blocked.groupBy("cid").agg(F.sum("links").alias("links"))
    found = alone.unionByName(joined.withColumnRenamed("node", "cid").join(links, "cid").select("cid", "label", "links"))
    found = common.written(found)
    common.dropped(texts)
    common.dropped(blocked)

    classed = signed.select("did.did", "did.tid", "cid").join(reps.select("cid", "m").join(found, "cid", "left"), "cid", "left")
    classed = classed.withColumn("label", F.coalesce("label", "cid"))
    smallest = classed.where("label is not null").groupBy("label").agg(F.min("did").alias("class_id"))
    return classed.join(smallest, "label", "left").select(
        F.col("did").alias(key),
        F.when(F.col("cid").isNull(), F.col("did")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("m", F.lit(1)).cast("long").alias("n_copies"),
        "tid",
        "label",
    )


def keep_one(docs: DataFrame, n: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, same columns, with one row of each group of linked texts: that with the smallest key.

    Rows without words all stay. Of rows that repeat key and text, one stays; of a group's texts with one key or only
    null keys, that with the smallest hash. Groups are told apart by their label: keys may repeat or be null.
    """
    found = _grouped(docs, n, similarity, key, text).select(F.col(key).alias("did"), "tid", "class_id", "label")
    stays = found.where(F.col("did").eqNullSafe(F.col("class_id")))
    first = common.written(stays.groupBy("label", "class_id", "tid").agg(F.count(F.lit(1)).alias("rows")))
    one = first.where("label is not null").groupBy("label", "class_id").agg(F.min(F.struct("tid", "rows")).alias("c"))
    one = one.select("class_id", F.col("c.tid").alias("_tid"), "c.rows", F.lit(True).alias("worded"))
    held = one.unionByName(first.where("label is null").select("class_id", F.col("tid").alias("_tid"), "rows", F.lit(False).alias("worded")))
    own = docs.withColumn("_tid", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = _matched(own, held, key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = kept.where("_rows = 1 or not _worded").select(*columns)
    return single.unionByName(kept.where("_rows > 1 and _worded").select(*columns, "_tid").dropDuplicates([key, "_tid"]).select(*columns))


def _matched(own: DataFrame, held: DataFrame, key: str) -> DataFrame:
    other = held.select(F.col("class_id").alias("_class"), F.col("_tid").alias("_t"), F.col("rows").alias("_rows"), F.col("worded").alias("_worded"))
    return own.join(other, (own["_tid"] == other["_t"]) & own[key].cast("long").eqNullSafe(other["_class"]))
