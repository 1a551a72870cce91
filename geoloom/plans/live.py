"""Registered live-feed queries; streams run over the events table as it lies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geoloom.operators import scratch
from geoloom.plans.base import FEED, feed, shared, t
from geoloom.plans.registry import register
from geoloom.streaming import keyed, live


@register(f"WITH {FEED} SELECT vehicle, min(seq) AS seq FROM feed WHERE k > 3 GROUP BY vehicle")
def stream_st1_admission(spark, d):
    rows, _ = live.admitted(feed(spark, d), "vehicle", F.col("k") > 3, "seq")
    return rows.select("vehicle", "seq")


_POLLS = "m AS (SELECT CAST(floor(avg(ms)) AS BIGINT) AS mid FROM feed), a AS (SELECT vehicle, max_by(k, seq) AS k FROM feed, m WHERE ms <= mid GROUP BY vehicle), b AS (SELECT vehicle, max_by(CASE WHEN k > 50 THEN k END, seq) FILTER (WHERE k > 50) AS k FROM feed, m WHERE ms > mid GROUP BY vehicle HAVING max_by(kind, seq) <> 'error')"


def _polls(spark, d):
    """Two polls: the earlier half of the time, and the later one without vehicles whose last report is an error."""
    f = feed(spark, d)
    y = f.crossJoin(F.broadcast(f.agg(F.floor(F.avg("ms")).alias("at"))))
    a = y.where("ms <= at").groupBy("vehicle").agg(F.max_by("k", "seq").alias("k"))
    big = F.when(F.col("k") > 50, F.col("k"))
    b = y.where("ms > at").groupBy("vehicle").agg(F.max_by(big, F.when(F.col("k") > 50, F.col("seq"))).alias("k"), F.max_by("kind", "seq").alias("kind")).where("kind != 'error'").drop("kind")
    return a.select("vehicle", "k", F.lit(0).cast("long").alias("seen_ms"), F.lit(0).alias("missed"), F.lit("add").alias("change")), b


@register(f"WITH {FEED}, {_POLLS} SELECT coalesce(a.vehicle, b.vehicle) AS vehicle, coalesce(b.k, a.k) AS k, CASE WHEN b.vehicle IS NULL THEN 'remove' WHEN a.vehicle IS NULL THEN 'add' ELSE 'update' END AS change FROM a FULL JOIN b ON a.vehicle = b.vehicle")
def stream_st2_reconcile(spark, d):
    state, poll = _polls(spark, d)
    return live.reconciled(state, poll, "vehicle", ["k"], True, 60_000).select("vehicle", "k", "change")


@register(f"WITH {FEED}, {_POLLS} SELECT coalesce(a.vehicle, b.vehicle) AS vehicle, CASE WHEN b.vehicle IS NULL THEN 'keep' WHEN a.vehicle IS NULL THEN 'add' ELSE 'update' END AS change FROM a FULL JOIN b ON a.vehicle = b.vehicle")
def stream_st3_partial(spark, d):
    state, poll = _polls(spark, d)
    return live.reconciled(state, poll, "vehicle", ["k"], False, 60_000).select("vehicle", "change")


@register()
def stream_st5_history(spark, d):
    f = feed(spark, d).select(F.col("vehicle").alias("key"), "ms", F.col("lat"), F.col("lon"), F.col("kind").alias("trip"))
    return live.history_batch(f)


@register(f"WITH {FEED}, m AS (SELECT vehicle, max(ms) AS newest FROM feed GROUP BY vehicle), n AS (SELECT max(ms) AS now FROM feed) SELECT vehicle, CASE WHEN now - newest > 120000 THEN 'stale' ELSE 'live' END AS state FROM m, n")
def stream_st8_staleness(spark, d):
    f = feed(spark, d)
    now = f.agg(F.max("ms").alias("now"))
    return f.groupBy("vehicle").agg(F.max("ms").alias("at")).crossJoin(F.broadcast(now)).select("vehicle", live.freshness(F.col("at"), F.col("now")).alias("state"))


@register(f"WITH {FEED} SELECT seq FROM feed JOIN (SELECT vehicle, max(k) AS k FROM feed GROUP BY vehicle) g USING (vehicle, k)")
def stream_st17_generation(spark, d):
    f = feed(spark, d).select("seq", F.col("vehicle").alias("source"), F.col("k").alias("generation"))
    return live.newest_generation(f).select("seq")


def _stream(spark, d, build, mode: str):
    """Run a stream over the whole table and return what it wrote, as Parquet in the folder that executors share."""
    schema = t(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "event_id", "user_id")
    folder = f"{shared(spark)}/streams/{uuid.uuid4().hex}"
    out, made = f"{folder}/out", build(rows)
    writer = made.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        spark.createDataFrame([], made.schema).write.parquet(out)  # stays if no batch comes
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


@register("SELECT CAST(epoch_us(ts) // 86400000000 * 86400000 AS BIGINT) AS from_ms, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def stream_st13_daily(spark, d):
    return _stream(spark, d, lambda rows: live.windowed(rows, "1 day"), "complete")


@register("SELECT CAST(epoch_us(ts) // 21600000000 * 21600000 - o * 21600000 AS BIGINT) AS from_ms, event_type AS kind, count(*) AS n FROM events, (SELECT unnest(range(4)) AS o) GROUP BY 1, 2")
def stream_st12_trailing(spark, d):
    return _stream(spark, d, lambda rows: live.windowed(rows, "24 hours", "6 hours"), "complete")


@register("SELECT event_id FROM events")
def stream_st5_no_repeats(spark, d):
    """Each event twice in one stream, once out."""
    return _stream(spark, d, lambda r: r.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append")


@register(f"WITH {FEED}, m AS (SELECT *, CASE WHEN k <= 30 THEN true WHEN k > 50 THEN false END AS mark FROM feed) SELECT seq, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS active FROM m")
def stream_st16_hysteresis(spark, d):
    return live.proximity(feed(spark, d), "vehicle", "k", 30, 20, "seq").select("seq", "active")


@register(f"""WITH {FEED}, f AS (SELECT vehicle, ms, max(k) AS k FROM feed GROUP BY 1, 2), l AS (SELECT *, lead(ms) OVER w AS t2, lead(k) OVER w AS k2 FROM f WINDOW w AS (PARTITION BY vehicle ORDER BY ms)),
q AS (SELECT DISTINCT vehicle, 1705000000000 AS ms FROM feed)
SELECT q.vehicle, round(CASE WHEN t2 IS NOT NULL THEN l.k + (k2 - l.k) * (q.ms - l.ms) * 1.0 / (t2 - l.ms) ELSE l.k END, 4) AS lat, CASE WHEN l.ms IS NULL THEN 'NO FIX' WHEN t2 IS NULL THEN 'WAITING' ELSE 'EN ROUTE' END AS motion FROM q ASOF LEFT JOIN l ON q.vehicle = l.vehicle AND q.ms >= l.ms""")
def stream_st7_playback(spark, d):
    f = feed(spark, d).groupBy("vehicle", "ms").agg(F.max("k").cast("double").alias("lat")).withColumn("lon", F.col("lat"))
    asked = f.select("vehicle").distinct().withColumn("ms", F.lit(1705000000000))
    return live.interpolated(f, asked, "vehicle", "ms").select("vehicle", F.round("lat", 4).alias("lat"), "motion")


_SIX = "b AS (SELECT min(ms) AS low, max(ms) AS high FROM feed), p AS (SELECT vehicle, least(5, (ms - low) * 6 // (high - low + 1)) AS poll, max_by(CASE WHEN k > 50 THEN k END, seq) FILTER (WHERE k > 50) AS k FROM feed, b GROUP BY 1, 2 HAVING max_by(kind, seq) <> 'error')"


@register(f"""WITH {FEED}, {_SIX}, r AS (SELECT *, poll - row_number() OVER (PARTITION BY vehicle ORDER BY poll) AS run FROM p),
c AS (SELECT vehicle, poll, run, last_value(k IGNORE NULLS) OVER (PARTITION BY vehicle, run ORDER BY poll ROWS UNBOUNDED PRECEDING) AS k, row_number() OVER (PARTITION BY vehicle, run ORDER BY poll) AS n, count(*) OVER (PARTITION BY vehicle, run) AS most FROM r)
SELECT vehicle, CAST(poll AS BIGINT) AS poll, k, CASE WHEN n = 1 THEN 'add' ELSE 'update' END AS change FROM c
UNION ALL SELECT vehicle, CAST(poll + 1 AS BIGINT), k, 'remove' FROM c WHERE n = most AND poll + 1 IN (SELECT poll FROM p)""")
def stream_st2_keyed(spark, d):
    """Six complete polls of the whole table, one micro-batch each, reconciled by keyed state and timers.

    A poll holds the vehicles of a sixth of the time, less those whose last report in it is an error.
    """
    f = feed(spark, d)
    span = f.agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    poll = F.least(F.lit(5), F.floor((F.col("ms") - F.col("low")) * 6 / (F.col("high") - F.col("low") + 1)).cast("long"))
    big = F.when(F.col("k") > 50, F.col("k"))
    rows = f.crossJoin(F.broadcast(span)).groupBy("vehicle", poll.cast("long").alias("poll")).agg(F.max_by(big, F.when(F.col("k") > 50, F.col("seq"))).alias("k"), F.max_by("kind", "seq").alias("kind")).where("kind != 'error'")
    folder = f"{shared(spark)}/streams/{uuid.uuid4().hex}"
    rows = scratch.written(rows.select("vehicle", "k", (F.col("poll") * 60_000).alias("poll_ms"), F.lit(True).alias("complete")))  # once, by all tasks; the polls are parts of it
    for n in range(6):  # a write a poll, so that the files are found in order; each a file, so that a poll is a micro-batch
        rows.where(F.col("poll_ms") == n * 60_000).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    polls = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = keyed.reconciled_stream(polls, "vehicle", ["k"])
    with keyed.state_store(spark):
        q = out.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/n={n}")).start()
        q.processAllAvailable()
        q.stop()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("vehicle", F.floor(F.col("poll_ms") / 60_000).alias("poll"), "k", "change")


@register(f"""WITH {FEED}, m AS (SELECT *, CASE WHEN k <= 30 THEN true WHEN k > 50 THEN false END AS mark FROM feed), a AS (SELECT vehicle, seq, coalesce(last_value(mark IGNORE NULLS) OVER w, false) AS active FROM m WINDOW w AS (PARTITION BY vehicle ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT vehicle, seq, active FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY vehicle ORDER BY seq), false) AS before FROM a) WHERE active <> before""")
def stream_st16_keyed(spark, d):
    """When vehicles come near and go away, as streaming state of each vehicle over the whole table."""
    folder = f"{shared(spark)}/streams/{uuid.uuid4().hex}"
    rows = feed(spark, d).select("vehicle", "seq", F.col("k").cast("double").alias("km"))
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    out = keyed.proximity_stream(stream, "vehicle", "km", 30, 20, "seq")
    with keyed.state_store(spark):
        out.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/n={n}")).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("vehicle", "seq", "active")
