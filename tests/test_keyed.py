"""Reconciliation and hysteresis as streaming state against the fold of polls, over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.streaming import keyed, live

SCHEMA = "vehicle long, name string, k long, poll_ms long, complete boolean"
STEP = 60_000


def made(seed, polls=9):
    """[(ms, complete, {vehicle: (name, k)})], some polls empty."""
    r = random.Random(seed)
    out, ms = [], 1_700_000_000_000
    for _ in range(polls):
        ms += r.choice([STEP, 2 * STEP, 3 * STEP, 7 * STEP])
        there = {} if r.random() < 0.15 else {v: (r.choice([None, f"n{v}"]), r.choice([None, r.randint(0, 9)])) for v in range(7) if r.random() < 0.6}
        out.append((ms, r.random() < 0.5, there))
    return out


def folded(polls, selected, state=None):
    """The changes of each poll, one after the other, by the plain rules."""
    held, changes = dict(state or {}), []
    for ms, complete, there in polls:
        if not there:
            continue
        for v in list(held):
            if v not in there:
                values, seen, missed = held[v]
                missed += 1
                held[v] = values, seen, missed
                if (missed > live.SELECTED_MISSES if v == selected else True) if complete else ms - seen > live.PARTIAL_MS:
                    changes.append((v, *values, seen, ms, "remove"))
                    del held[v]
        for v, new in there.items():
            old = held.get(v, ((None, None), 0, 0))[0]
            values = tuple(b if a is None else a for a, b in zip(new, old))
            changes.append((v, *values, ms, ms, "update" if v in held else "add"))
            held[v] = values, ms, 0
    return changes, held


def stream(spark, folder, selected, initial=None):
    polls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    out = keyed.reconciled_stream(polls, "vehicle", ["name", "k"], selected, initial)
    q = out.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/{n}")).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").start()
    q.processAllAvailable()
    q.stop()


def put(folder, polls, first=0):
    import json
    import os
    import time

    os.makedirs(f"{folder}/in", exist_ok=True)
    for n, (ms, complete, there) in enumerate(polls):
        rows = "".join(json.dumps({"vehicle": v, "name": a, "k": b, "poll_ms": ms, "complete": complete}) + "\n" for v, (a, b) in there.items())
        path = f"{folder}/in/{first + n:04d}.json"
        with open(path, "w") as f:
            f.write(rows)
        os.utime(path, (time.time() - 1000 + first + n,) * 2)


def changes_of(spark, folder):
    return sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out/*").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_fold_of_polls(spark, tmp_path, seed):
    """Also when it stops in the middle and goes on from its checkpoint."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        polls = made(seed)
        put(tmp_path, polls[:5])
        stream(spark, tmp_path, 3)
        put(tmp_path, polls[5:], 5)
        stream(spark, tmp_path, 3)
        want, held = folded(polls, 3)
        assert changes_of(spark, tmp_path) == sorted(want, key=str)
        assert {c[-1] for c in want} == {"add", "update", "remove"}
        # and the fold is the table version's
        state = spark.createDataFrame([], "vehicle long, name string, k long, seen_ms long, missed int, change string")
        for ms, complete, there in polls:
            snapshot = spark.createDataFrame([(v, *x) for v, x in there.items()], "vehicle long, name string, k long")
            state = spark.createDataFrame(live.reconciled(state, snapshot, "vehicle", ["name", "k"], complete, ms, selected=3).collect(), state.schema)
        assert {(r.vehicle, r.name, r.k, r.seen_ms) for r in state.where("change != 'remove'").collect()} == {(v, *x[0], x[1]) for v, x in held.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_stream_from_initial_state(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        now = 1_700_000_000_000
        polls = [(now + STEP, True, {1: (None, 5), 2: ("two", None)}), (now + 2 * STEP, False, {2: (None, 1)}), (now + 9 * STEP, False, {2: (None, 2)})]
        before = {1: (("one", 4), now, 0), 9: (("nine", 9), now, 0)}
        initial = spark.createDataFrame([(v, *x[0], x[1], x[2]) for v, x in before.items()], "vehicle long, name string, k long, seen_ms long, missed int")
        put(tmp_path, polls)
        stream(spark, tmp_path, None, initial)
        assert changes_of(spark, tmp_path) == sorted(folded(polls, None, before)[0], key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_hysteresis_stream(spark, tmp_path):
    import json
    import os

    r = random.Random(3)
    rows = [(v, n, float(r.randint(0, 100))) for n in range(60) for v in range(3)]
    os.makedirs(tmp_path / "in")
    for part in range(3):
        with open(tmp_path / "in" / f"{part}.json", "w") as f:
            f.write("".join(json.dumps({"vehicle": v, "n": n, "km": km}) + "\n" for v, n, km in rows if n // 20 == part))
        os.utime(tmp_path / "in" / f"{part}.json", (1_700_000_000 + part,) * 2)
    feed = spark.readStream.schema("vehicle long, n long, km double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = keyed.proximity_stream(feed, "vehicle", "km", 30, 20, "n").writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", f"{tmp_path}/c").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    table = live.proximity(spark.createDataFrame(rows, "vehicle long, n long, km double"), "vehicle", "km", 30, 20, "n").orderBy("vehicle", "n").collect()
    want, last = [], {}
    for x in table:
        if x.active != last.get(x.vehicle, False):
            want.append((x.vehicle, x.n, x.active))
        last[x.vehicle] = x.active
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/*").select("vehicle", "n", "active").collect())) == sorted(want) and len(want) > 6
