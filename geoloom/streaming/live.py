"""Live feeds: admission of snapshots, keyed state with retention, bounded history, staleness."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Retention of partial snapshots, time to live, ring sizes, staleness.
PARTIAL_MS, TTL_MS, MOST_FIXES, MOST_EPOCHS = 5 * 60_000, 15 * 60_000, 128, 8
STALE_S, SELECTED_MISSES, MOST_POLLS_MISSED = 120, 3, 3


def admitted(df: DataFrame, key: str, valid: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows that are valid, the first of each key; one row with accepted, rejected, complete)."""
    first = df.where(valid & F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")
    n = df.agg(F.count(F.lit(1)).alias("n")).crossJoin(first.agg(F.count(F.lit(1)).alias("accepted")))
    return first, n.select("accepted", (F.col("n") - F.col("accepted")).alias("rejected"), (F.col("n") == F.col("accepted")).alias("complete"))


def admission(df: DataFrame, source: str, key: str, valid: Column, order: str) -> DataFrame:
    """(source, accepted, rejected, complete) of each source's snapshot: of each key its first row counts, if it is valid.

    Counts are combined before each shuffle; rows without a key are rejected.
    """
    first = df.groupBy(source, key).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.min_by(valid, order), F.lit(False)).alias("_ok"))
    accepted = F.count_if(F.col("_ok") & F.col(key).isNotNull())
    return first.groupBy(source).agg(accepted.alias("accepted"), (F.sum("_n") - accepted).alias("rejected"), (F.sum("_n") == accepted).alias("complete"))


def freshness(at_ms: Column, now_ms: Column, stale_s: int = STALE_S) -> Column:
    """unknown without a time, stale beyond a number of seconds, else live."""
    return F.when(at_ms.isNull(), "unknown").when((now_ms - at_ms) > stale_s * 1000, "stale").otherwise("live")


def reconciled(state: DataFrame, snapshot: DataFrame, key: str, carried: list[str], complete: bool, now_ms: int, selected: str | None = None, most: int | None = None) -> DataFrame:
    """The next state (key, carried, seen_ms, missed, change) from the last one and a snapshot of unique keys.

    Missing values are carried forward. Keys that the snapshot lacks go at once if it is complete (the selected one
    after SELECTED_MISSES more), and when older than PARTIAL_MS if it is partial. An empty snapshot keeps everything.
    change is add, update, keep or remove; removed rows are listed once. Beyond `most` rows the oldest go.
    """
    if snapshot.isEmpty():
        return state.withColumn("change", F.lit("keep"))
    new = snapshot.select(key, *(F.col(c).alias(f"_n_{c}") for c in carried), F.lit(True).alias("_in"))
    j = state.where("change is null or change != 'remove'").drop("change").join(new, key, "full")
    there, known = F.coalesce("_in", F.lit(False)), F.col("seen_ms").isNotNull()
    missed = F.when(there, 0).otherwise(F.col("missed") + 1)
    gone = F.when(F.lit(complete), F.when(F.col(key) == F.lit(selected), missed > SELECTED_MISSES).otherwise(True)).otherwise(F.lit(now_ms) - F.col("seen_ms") > PARTIAL_MS)
    change = F.when(there & ~known, "add").when(there, "update").when(F.coalesce(gone, F.lit(False)), "remove").otherwise("keep")
    out = j.select(key, *(F.coalesce(f"_n_{c}", c).alias(c) for c in carried), F.when(there, F.lit(now_ms)).otherwise(F.col("seen_ms")).alias("seen_ms"), missed.cast("int").alias("missed"), change.alias("change"))
    if most is None:
        return out
    return out.where("change != 'remove'").orderBy(F.desc("seen_ms"), key).limit(most).unionByName(out.where("change = 'remove'"))


def newest_generation(batches: DataFrame, source: str = "source") -> DataFrame:
    """Of each source the rows of its highest generation; a lower one that comes later changes nothing."""
    top = batches.groupBy(source).agg(F.max("generation").alias("generation"))
    return batches.join(top, [source, "generation"], "left_semi")


@dataclass
class Ring:
    """Fixes of one key: at most MOST_FIXES over at most MOST_EPOCHS trips, none older than TTL_MS before the newest."""

    fixes: list[tuple] = field(default_factory=list)
    epochs: list[tuple] = field(default_factory=list)
    truncated: bool = False

    def add(self, ms: int, lat: float, lon: float, trip: str | None = None) -> bool:
        """Append a fix; one that is not later than the last is refused."""
        if self.fixes and ms <= self.fixes[-1][0]:
            return False
        if not self.epochs or self.epochs[-1][1] != trip:
            self.epochs.append(((self.epochs[-1][0] + 1) if self.epochs else 0, trip))
        self.fixes.append((ms, lat, lon, self.epochs[-1][0]))
        while self.fixes[0][0] < ms - TTL_MS:
            self.fixes.pop(0)
        if len(self.fixes) > MOST_FIXES:
            self.fixes, self.truncated = self.fixes[-MOST_FIXES:], True
        used = {f[3] for f in self.fixes}
        self.epochs = [e for e in self.epochs if e[0] in used][-MOST_EPOCHS:]
        kept = {e[0] for e in self.epochs}
        if any(f[3] not in kept for f in self.fixes):
            self.fixes, self.truncated = [f for f in self.fixes if f[3] in kept], True
        return True


@dataclass
class Track:
    """Plausible movement of one key: a lone jump is refused, a second one that agrees with it breaks the path."""

    last: tuple | None = None
    pending: tuple | None = None
    most_mps: float = 70.0

    def accept(self, ms: int, lat: float, lon: float) -> str:
        """path (continues), wait (implausible so far) or break (the path starts anew)."""
        if self.last is None:
            self.last = (ms, lat, lon)
            return "path"
        if ms <= self.last[0]:
            return "wait"
        if self._speed(self.last, (ms, lat, lon)) <= self.most_mps:
            self.last, self.pending = (ms, lat, lon), None
            return "path"
        if self.pending and ms > self.pending[0] and self._speed(self.pending, (ms, lat, lon)) <= self.most_mps:
            self.last, self.pending = (ms, lat, lon), None
            return "break"
        self.pending = (ms, lat, lon)
        return "wait"

    @staticmethod
    def _speed(a, b) -> float:
        import math

        y = math.radians(b[1] - a[1])
        x = math.radians(b[2] - a[2]) * math.cos(math.radians((a[1] + b[1]) / 2))
        return 6_371_000 * math.hypot(x, y) / max(0.001, (b[0] - a[0]) / 1000)


HISTORY = "key long, ms long, fixes int, epochs int, truncated boolean, motion string"


def _step(ring: Ring, track: Track, ms, lat, lon, trip) -> str:
    motion = track.accept(int(ms), float(lat), float(lon))
    if motion != "wait":
        ring.add(int(ms), float(lat), float(lon), trip)
    return motion


def _summary(key, ring: Ring, motion: str) -> dict:
    return {"key": key, "ms": ring.fixes[-1][0] if ring.fixes else None, "fixes": len(ring.fixes), "epochs": len(ring.epochs), "truncated": ring.truncated, "motion": motion}


def _history(key, rows: pd.DataFrame, ring: Ring, track: Track) -> dict:
    motion = "wait"
    for fix in rows.sort_values(["ms", "lat", "lon"])[["ms", "lat", "lon", "trip"]].itertuples(index=False):
        motion = _step(ring, track, *fix)
    return _summary(key, ring, motion)


class History(StatefulProcessor):
    """Ring and track of each key as streaming state; a row for each key in each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", "value string", ttlDurationMs=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = json.loads(self.state.get()[0]) if self.state.exists() else None
        ring = Ring([tuple(f) for f in held["fixes"]], [tuple(e) for e in held["epochs"]], held["truncated"]) if held else Ring()
        track = Track(*(tuple(x) if x else None for x in held["track"])) if held else Track()
        out = _history(key[0], pd.concat(list(rows)), ring, track)
        self.state.update((json.dumps({"fixes": ring.fixes, "epochs": ring.epochs, "truncated": ring.truncated, "track": [track.last, track.pending]}),))
        yield pd.DataFrame([out])

    def close(self) -> None:
        pass


def history_stream(feed: DataFrame) -> DataFrame:
    """Histories of a stream of (key, ms, lat, lon, trip)."""
    return feed.groupBy("key").transformWithStateInPandas(History(), HISTORY, "Update", "None")


def history_batch(feed: DataFrame) -> DataFrame:
    """The same fold over a table: one row for each key.

    Fixes come sorted by key and time, so a task holds one ring and one track, however many fixes a key has.
    """

    def fold(batches):
        key, ring, track, motion = None, None, None, "wait"
        for b in batches:
            out = []
            for k, *fix in b[["key", "ms", "lat", "lon", "trip"]].itertuples(index=False):
                if ring is None or k != key:
                    if ring is not None:
                        out.append(_summary(key, ring, motion))
                    key, ring, track = k, Ring(), Track()
                motion = _step(ring, track, *fix)
            if out:
                yield pd.DataFrame(out)
        if ring is not None:
            yield pd.DataFrame([_summary(key, ring, motion)])

    dealt = feed.where("key is not null").repartition("key").sortWithinPartitions("key", "ms", "lat", "lon")
    return dealt.mapInPandas(fold, HISTORY)


def windowed(feed: DataFrame, length: str, slide: str | None = None, late: str = "15 minutes") -> DataFrame:
    """Counts by kind in event-time windows of a stream or table (time column ts, a timestamp)."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    marked = feed.withWatermark("ts", late) if feed.isStreaming else feed
    return marked.groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("w.start").alias("from_ms"), "kind", "n")


def proximity(feed: DataFrame, key: str, km: str, reach: float, slack: float, order: str) -> DataFrame:
    """feed with `active`: on within reach, off beyond reach + slack, between the two as before."""
    from pyspark.sql import Window as W

    mark = F.when(F.col(km) <= reach, True).when(F.col(km) > reach + slack, False)
    return feed.withColumn("active", F.coalesce(F.last(mark, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)), F.lit(False)))


def interpolated(feed: DataFrame, at: DataFrame, key: str, time: str) -> DataFrame:
    """Positions at asked times: between the fixes around, else the last one; motion is EN ROUTE, WAITING or NO FIX."""
    from geoloom.operators.joins import asof

    from pyspark.sql import Window as W

    nxt = lambda c: F.lead(c).over(W.partitionBy(key).orderBy(time))
    legs = feed.select(key, time, "lat", "lon", nxt(time).alias("t2"), nxt("lat").alias("lat2"), nxt("lon").alias("lon2"))
    j = asof(at, legs, [key], time, ["lat", "lon", "t2", "lat2", "lon2"])
    f = (F.col(time) - F.col("at")) / (F.col("t2") - F.col("at"))
    between = lambda a, b: F.when(F.col("t2").isNotNull(), F.col(a) + (F.col(b) - F.col(a)) * f).otherwise(F.col(a))
    motion = F.when(F.col("at").isNull(), "NO FIX").when(F.col("t2").isNull(), "WAITING").otherwise("EN ROUTE")
    return j.select(*at.columns, between("lat", "lat2").alias("lat"), between("lon", "lon2").alias("lon"), motion.alias("motion"))
