"""Polls of a feed reconciled as streaming state: one state and one event-time timer for each key.

Each micro-batch is one poll, and the watermark, without delay, is the time of the last poll before it. A key that a poll
lacks gets no row; its timer tells it, once the watermark has passed the time it was last seen. Whether the polls it missed
were complete is told by the watermark too: poll times count in steps of two milliseconds, and the odd one marks a
complete poll. An empty poll brings no row, moves no watermark and changes nothing.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geoloom.streaming.live import PARTIAL_MS, SELECTED_MISSES


#: Setting and value of the state store that keyed state needs.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark):
    """The session with the store that keyed state needs, for streams that start within; its own setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before is not None else spark.conf.unset(_STORE)


def poll_time(ms, complete):
    """The event time of a poll: its milliseconds, even for a partial poll and odd for a complete one."""
    return F.timestamp_millis(ms - F.pmod(ms, F.lit(2)) + F.when(complete, 1).otherwise(0))


def _plain(v):
    return None if v is None or v is pd.NaT or isinstance(v, float) and v != v else v.item() if hasattr(v, "item") else v


class Reconcile(StatefulProcessor):
    """State of a key: its carried values, when it was last seen, and the polls that it missed since."""

    def __init__(self, key: str, carried: list[str], kinds: list[str], selected=None):
        self.key, self.carried, self.kinds, self.selected = key, carried, kinds, selected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "value string")

    def _held(self) -> dict | None:
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def _hold(self, held: dict) -> None:
        self.state.update((json.dumps(held),))

    def _row(self, key, held: dict, poll: int, change: str) -> dict:
        return {self.key: key[0], **held["values"], "seen_ms": held["seen"], "poll_ms": poll, "change": change}

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[self.key, *self.carried, "seen_ms", "poll_ms", "change"])
        return frame.astype({c: "Int64" for c, k in zip(self.carried, self.kinds) if k in ("bigint", "int")})

    def _absent(self, key, held: dict, mark: int) -> tuple[bool, int]:
        """Whether the poll of a watermark, which lacks the key, removes it; and the poll's time."""
        now, complete = mark - mark % 2, bool(mark % 2)
        held["missed"] += 1
        return (held["missed"] > SELECTED_MISSES if key[0] == self.selected else True) if complete else now - held["seen"] > PARTIAL_MS, now

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, out = self._held(), []
        mark = timerValues.getCurrentWatermarkInMs()
        if held and held["told"] < mark and held["seen"] < mark - mark % 2:  # the poll before this one lacked the key
            gone, now = self._absent(key, held, mark)
            if gone:
                out.append(self._row(key, held, now, "remove"))
                held = None
        new, seen = {}, None
        for batch in rows:
            for r in batch.sort_values("poll_ms").to_dict("records"):
                seen = int(r["poll_ms"]) - int(r["poll_ms"]) % 2
                new |= {c: _plain(r[c]) for c in self.carried if _plain(r[c]) is not None}
        change = "update" if held else "add"
        values = {c: new.get(c, held["values"].get(c) if held else None) for c in self.carried}
        held = {"values": values, "seen": seen, "missed": 0, "told": seen + 1}
        self._hold(held)
        self._timer(seen + 2)
        out.append(self._row(key, held, seen, change))
        yield self._frame(out)

    def _timer(self, at: int) -> None:
        """The next poll's: any later watermark."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, mark = self._held(), timerValues.getCurrentWatermarkInMs()
        if held is None:
            return
        if mark <= held["told"]:  # no poll has come since
            self.handle.registerTimer(held["told"] + 1)
            return
        gone, now = self._absent(key, held, mark)
        if gone:
            self.state.clear()
            yield self._frame([self._row(key, held, now, "remove")])
        else:
            held["told"] = mark
            self._hold(held)
            self.handle.registerTimer(mark + 1)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0].to_dict()
        seen = int(r["seen_ms"]) - int(r["seen_ms"]) % 2
        self._hold({"values": {c: _plain(r[c]) for c in self.carried}, "seen": seen, "missed": int(r.get("missed") or 0), "told": seen + 1})
        self._timer(seen + 2)

    def close(self) -> None:
        pass


def reconciled_stream(polls: DataFrame, key: str, carried: list[str], selected=None, initial: DataFrame | None = None) -> DataFrame:
    """Changes of a stream of polls (key, carried, poll_ms, complete): add, update and remove, with the poll's time.

    The stream gives one poll a micro-batch (maxFilesPerTrigger 1, a file a poll). Values that a poll lacks are carried
    forward. A key that a complete poll lacks is removed at once, the selected one when it has missed SELECTED_MISSES
    polls before; a partial poll removes what was last seen more than PARTIAL_MS earlier. The result is the fold of
    `live.reconciled` over the polls, less the rows it keeps. initial: (key, carried, seen_ms, missed) to begin from.
    Numbers are carried as they are, other values as texts; null keys are left out.
    """
    types = {f.name: f.dataType for f in polls.schema.fields}
    kinds = [types[c].simpleString() for c in carried]
    fields = [(key, types[key]), *((c, types[c]) for c in carried), ("seen_ms", T.LongType()), ("poll_ms", T.LongType()), ("change", T.StringType())]
    marked = polls.where(F.col(key).isNotNull()).withColumn("_at", poll_time(F.col("poll_ms"), F.col("complete"))).withWatermark("_at", "0 seconds")
    return marked.groupBy(key).transformWithStateInPandas(
        Reconcile(key, carried, kinds, selected), T.StructType([T.StructField(n, t) for n, t in fields]), "Update", "EventTime",
        initialState=initial.groupBy(key) if initial is not None else None,
    )


class Hysteresis(StatefulProcessor):
    """Whether a key is near: on within reach, off beyond reach and slack, between the two as before."""

    def __init__(self, key: str, km: str, order: str, reach: float, slack: float):
        self.key, self.km, self.order, self.reach, self.slack = key, km, order, reach, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("active", "value boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        active = bool(self.state.get()[0]) if self.state.exists() else False
        changes = []
        # of a batch only order and distance of each row are held, to put them in order
        held = pd.concat([b[[self.order, self.km]] for b in rows]).sort_values(self.order, kind="stable")
        for at, km in held.itertuples(index=False):
            now = active if km != km or self.reach < km <= self.reach + self.slack else km <= self.reach
            if now != active:
                changes.append((key[0], at, now))
            active = now
        self.state.update((active,))
        yield pd.DataFrame(changes, columns=[self.key, self.order, "active"])

    def close(self) -> None:
        pass


def proximity_stream(feed: DataFrame, key: str, km: str, reach: float, slack: float, order: str) -> DataFrame:
    """(key, order, active) of each time a key comes near or goes away, over a stream of distances that come in order."""
    types = {f.name: f.dataType for f in feed.schema.fields}
    schema = T.StructType([T.StructField(key, types[key]), T.StructField(order, types[order]), T.StructField("active", T.BooleanType())])
    return feed.where(F.col(key).isNotNull()).select(key, order, km).groupBy(key).transformWithStateInPandas(Hysteresis(key, km, order, reach, slack), schema, "Update", "None")
