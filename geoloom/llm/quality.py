"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Each rule scores a text; a cutoff rejects what scores at or above it. Labelled texts that only try out cutoffs give
each stratum one path, on which the rules' cutoffs become stricter one step at a time. On labelled texts that no other
step has used, an exact binomial test asks for each place of the path whether the share of good texts that any rule
rejects is below the allowed one. The first place that fails ends the sequence, so testing many costs nothing. The
error probability is shared by the strata that are tested, and by rules within them, so that with probability
1 - DELTA no stratum loses more than ALPHA of its good texts. Which strata are tested follows from their paths and
their numbers of good texts alone, not from what the tests would find. Sources with too few good labels for a test of
their own form one stratum together, and the bound holds for that stratum as a whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

#: Allowed share of good texts rejected in a stratum; probability that the bound fails anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Cutoffs of a rule: score = step / STEPS for the steps STEPS..1.
STEPS = 100
#: The rules: each is a share of the text in [0, 1], larger is worse.
RULES = ("symbols", "duplicate_lines", "repeated_words", "short_words", "long_words")
#: The share of labelled texts that tries out which cutoffs are worth testing; the rest is the holdout.
TRIED = 0.25

_SYMBOLS = b"#*$%&|<>"


def _features(min_window: int):
    def features(batches):
        kept = windows.Values()
        for batch in batches:
            raw, at = common.texts(batch.column("text"))
            out = []
            for k in range(batch.num_rows):
                text = bytes(raw[at[k] : at[k + 1]])
                words = text.split()
                n_words = len(words)
                joined = b"".join(words)
                chars = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0)))) if not joined.isascii() else 0
                chars = len(joined) - chars
                symbols = len(text) - len(text.translate(None, _SYMBOLS))
                seen, dups, lines = set(), 0, 0
                for line in text.split(b"\n"):
                    if line.strip():
                        lines += 1
                        dups += line in seen
                        seen.add(line)
                short = sum(len(w) <= 1 for w in words)
                long = sum(len(w) > 30 for w in words)
                out.append((n_words, chars, symbols, dups, _repeated(words, min_window, kept), lines, short, long))
            cols = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, pa.int64()) for c in cols)], ["row", *_NAMES])

    return features


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_short", "n_long")


def _repeated(words: list[bytes], length: int, kept: windows.Values) -> int:
    """Words inside windows of a length that the text holds twice or more."""
    if len(words) <= length:
        return 0
    values = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
    prints = windows.fingerprints(values, length, np.arange(len(values) - length + 1))
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    if not same.any():
        return 0
    starts = np.unique(np.r_[order[1:][same], order[:-1][same]])
    a, b = windows.runs(starts, length)
    return int((b - a).sum())


def scores(df: DataFrame) -> DataFrame:
    """df with each rule's score, 0 where the text has nothing to measure."""
    ratio = lambda a, b: F.coalesce(F.least(F.lit(1.0), F.col(a) / F.nullif(F.col(b), F.lit(0))), F.lit(0.0))
    parts = (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_short", "n_words"), ("n_long", "n_words"))
    return df.withColumns({rule: ratio(*p) for rule, p in zip(RULES, parts)})


def tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed in logs."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    steps = np.log((n - i[:-1]) / (i[:-1] + 1)) + math.log(p / (1 - p))
    logs = n * math.log1p(-p) + np.r_[0, np.cumsum(steps)]
    top = logs.max()
    return min(1.0, float(np.exp(logs - top).sum() * math.exp(top)) if top > -745 else 0.0)


def least_rejections(n: int, p: float, level: float) -> int:
    """The largest number of rejections of n good texts that still shows, at a level, a rate below p (-1: none)."""
    if n * math.log1p(-p) > math.log(level):
        return -1
    i = np.arange(min(n, int(n * p) + 1))
    logs = n * math.log1p(-p) + np.r_[0, np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1)) + math.log(p / (1 - p)))] if len(i) else np.zeros(0)
    return int(np.searchsorted(np.logaddexp.accumulate(logs), math.log(level), "right")) - 1


def _path(rows: pd.DataFrame) -> pd.DataFrame:
    """For one stratum: moves in their order, rule * STEPS + i for the cutoff (STEPS - i) / STEPS, from the tried counts.

    Each rule moves along the hull of what it rejects of bad and good texts, as long as it gains more bad ones; the
    rules' moves are merged by that ratio.
    """
    tried, moves = rows[rows["tried"]], []
    for r, rule in enumerate(RULES):
        mine = tried[tried["rule"] == rule]
        count = lambda quality: np.bincount(mine.loc[mine["quality"] == quality, "step"], mine.loc[mine["quality"] == quality, "n"], STEPS + 1)[::-1].cumsum()  # noqa: E731, B023
        bad, good = count(0), count(1)
        unseen = np.arange(1, STEPS + 1) / (STEPS * max(1, good[-1]))  # each step may reject good texts that were not tried
        bad, good = (x[:STEPS] / max(1, x[-1]) for x in (bad, good))
        at, b, g = -1, 0.0, 0.0
        while at < STEPS - 1:
            more, lost = bad[at + 1 :] - b, good[at + 1 :] - g
            ratio = more / (lost + unseen[: len(more)])
            j = int(ratio.argmax())
            if more[j] <= lost[j]:
                break
            moves += [(-ratio[j], r, i) for i in range(at + 1, at + 2 + j)]
            at += 1 + j
            b, g = bad[at], good[at]
    out = rows[["stratum"]].iloc[:1].copy()
    out["moves"] = [[r * STEPS + i for _, r, i in sorted(moves)]]
    return out


def _strictest(moves, upto: int) -> list[int]:
    """Each rule's index i after the first moves (-1: no cutoff)."""
    best = [-1] * len(RULES)
    for m in moves[:upto]:
        best[m // STEPS] = max(best[m // STEPS], int(m) % STEPS)
    return best


def _reached(batches):
    """For each stratum, rule and step of a score: after how many moves the rule rejects it (null: never)."""
    for rows in batches:
        out = []
        for moves in rows["moves"]:
            at = [[None] * (STEPS + 1) for _ in RULES]
            for k, m in enumerate(moves, 1):
                r, i = divmod(int(m), STEPS)
                for step in range(STEPS - i, STEPS + 1):
                    at[r][step] = k if at[r][step] is None else at[r][step]
            out.append(at)
        yield pd.DataFrame({"stratum": rows["stratum"], "reached": out})


def _tested(alpha: float, least: int, level: float):
    """The strictest place of each stratum's path that the tests in sequence allow; none with fewer good texts than least."""

    def tested(batches):
        for rows in batches:
            out = []
            for stratum, moves, n, held in rows[["stratum", "moves", "n_good", "held"]].itertuples(index=False):
                good = np.zeros(len(moves) + 1, np.int64)
                for h in held if held is not None else ():
                    good[h["at"]] = h["n"]
                good, best = good.cumsum(), 0
                if n >= least and len(moves):
                    best = max(0, int(np.searchsorted(good, least_rejections(n, alpha, level), "right")) - 1)
                for rule, i in zip(RULES, _strictest(moves, best)):
                    out.append((stratum, rule, (STEPS - i) / STEPS if i >= 0 else None, n, int(good[best]) if best else 0, alpha))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _CUTOFFS.split(", ")])

    return tested


_CUTOFFS = "stratum string, rule string, cutoff double, n_good long, n_false long, bound double"


def _shared_level(numbers: dict[int, int], alpha: float, delta: float) -> tuple[int, float]:
    """(good texts that a tested stratum has at least, level of its test) from how many strata have which number.

    Of strata by descending number, as many are tested as could all pass when they share delta with the rules.
    """
    found, strata = (1 << 62, 0.0), 0
    for n in sorted(numbers, reverse=True):
        strata += numbers[n]
        level = delta / (strata * len(RULES))
        if n * math.log1p(-alpha) <= math.log(level):
            found = n, level
    return found


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_false, bound) from (id, stratum, quality, scores of each rule).

    A null cutoff means that none is shown to be safe: the rule then rejects nothing in that stratum. n_good are the
    stratum's good texts of the holdout, n_false those of them that its rules reject together. Only counts by stratum,
    rule and step, or place of the path, are gathered, so no group holds more than 4 * len(RULES) * (STEPS + 1) rows.
    """
    tried = _tried()
    steps = F.array(*(F.floor(F.col(r) * STEPS).cast("int") for r in RULES))
    rows = labelled.select("stratum", F.col("quality").cast("int").alias("quality"), tried.alias("tried"), steps.alias("steps"))
    long = rows.select("stratum", "quality", "tried", F.explode(F.arrays_zip(F.array(*map(F.lit, RULES)).alias("rule"), F.col("steps").alias("step"))).alias("s"))
    counts = long.groupBy("stratum", "s.rule", "s.step", "quality", "tried").agg(F.count(F.lit(1)).alias("n"))
    paths = common.written(counts.groupBy("stratum").applyInPandas(_path, "stratum string, moves array<int>"))
    reached = paths.mapInPandas(_reached, "stratum string, reached array<array<int>>")
    held = rows.where("quality = 1 and not tried").join(common.small_side(common.written(reached), 1000), "stratum")
    at = F.array_min(F.zip_with("reached", "steps", lambda r, s: F.get(r, s)))
    places = held.groupBy("stratum", at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    places = places.groupBy("stratum").agg(F.sum("n").alias("n_good"), F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n"))).alias("held"))
    judged = common.written(paths.join(places, "stratum", "left").withColumn("n_good", F.coalesce("n_good", F.lit(0)).cast("long")))
    most = math.ceil(math.log(1e-18) / math.log1p(-alpha))  # with more good texts a stratum passes however many share delta
    numbers = judged.where(F.size("moves") > 0).groupBy(F.least("n_good", F.lit(most)).alias("n")).agg(F.count(F.lit(1)).alias("strata")).collect()
    return judged.mapInPandas(_tested(alpha, *_shared_level({x.n: x.strata for x in numbers}, alpha, delta)), _CUTOFFS)


#: The stratum of all sources with too few good labels.
POOLED = "p"


def least_labels(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good texts of the holdout that a stratum needs to pass at all when so many strata share delta with the rules."""
    return math.ceil(math.log(delta / (strata * len(RULES))) / math.log1p(-alpha))


def own_strata(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, own) of the strata of labelled with enough good holdout labels for a test, if as many as there are were tested."""
    good = labelled.where("quality = 1").groupBy("stratum").agg(F.count(F.when(~_tried(), 1)).alias("n"))
    good = common.written(good)
    return good.where(F.col("n") >= least_labels(good.count() + 1, alpha, delta)).select("stratum", F.lit(True).alias("own"))


def _tried() -> F.Column:
    return F.pmod(F.xxhash64("id", F.lit("tried")), F.lit(100)) < int(100 * TRIED)


def measured(docs: DataFrame, key: str, text: str, stratum: str, repeat: int = 8) -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    row = F.struct(F.col(key).alias("did"), F.coalesce(F.concat(F.lit("s"), F.col(stratum)), F.lit("n")).alias("stratum"))
    kind = docs.select(row.alias("row")).schema["row"].dataType.simpleString()
    out = docs.select(row.alias("row"), F.col(text).alias("text")).mapInArrow(_features(repeat), f"row {kind}, " + ", ".join(f"{x} long" for x in _NAMES))
    return out.select("row.did", "row.stratum", *_NAMES)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, key: str = "doc_id", text: str = "text", stratum: str = "source", label: str = "quality") -> DataFrame:
    """Whether each text passes the base rules and the calibrated ones: a row for each row of docs.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words are runs of other characters than
    space and \\t to \\r), base_failed (n_words < 20, or over 30 % of the words in 8-word windows that come twice),
    kept, and rejected_by (the rules whose cutoff for the stratum the text reaches; see `cutoffs`).

    labels: (key, label), 1 good and 0 bad. Labels that are null or have no text count for nothing; a key with several
    labels or several texts counts once for each pair. Only texts that pass the base rules calibrate. Sources with too
    few good labels (`own_strata`) are judged together, as one stratum. A null text has no words and so fails; a null
    source is a source of its own; repeated rows are judged alike; other columns are ignored; empty tables give an empty
    result or reject nothing.
    """
    rows = measured(docs, key, text, stratum)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = common.written(scores(rows.withColumn("base_failed", failed)))
    marks = labels.select(F.col(key).alias("did"), F.col(label).cast("int").alias("quality")).where("quality in (0, 1)")
    labelled = rows.where("not base_failed").join(marks, "did").select(F.col("did").alias("id"), "stratum", "quality", *RULES)
    labelled = common.written(labelled)
    own = common.small_side(common.written(own_strata(labelled, alpha, delta)), 10_000)
    pooled = lambda df: df.join(own, "stratum", "left").withColumn("stratum", F.when(F.col("own"), F.col("stratum")).otherwise(POOLED)).drop("own")
    rows, labelled = pooled(rows), pooled(labelled)
    found = common.written(cutoffs(labelled, alpha, delta).where("cutoff is not null and not isnan(cutoff)").groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")))
    limits = found.select("stratum", *(F.col(r).alias(f"{r}_cutoff") for r in RULES))
    out = rows.join(common.small_side(limits, 10_000), "stratum", "left")
    by = F.filter(F.array(*(F.when(F.floor(F.col(r) * STEPS) / STEPS >= F.col(f"{r}_cutoff"), r) for r in RULES)), lambda x: x.isNotNull())
    out = out.withColumn("rejected_by", by)
    return out.select(F.col("did").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
