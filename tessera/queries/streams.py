"""Streams over the events table, read as a file source."""

from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import state as S


def stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def ended(stream, mode="append"):
    return S.run_to_end(stream, mode)


def stepped(spark, d, step, start, state, out):
    """Events of each user in the order of time."""
    return ended(S.stateful(stream(spark, d), "user_id", step, start, state, f"user_id long, event_id long, {out}", ["ts", "event_id"]))


W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = S.windowed(stream(spark, d), "ts", "1 day", "10 minutes", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return ended(out, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH o AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::int, 1) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.sessions(events, "ts", "6 hours", "1 hour", ["user_id"], F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"SELECT user_id, event_id, row_number() OVER w AS count FROM (SELECT * FROM events {W} QUALIFY value > 50 AND NOT coalesce(lag(value > 50) OVER w, false)) {W}")
def stream_edge_counter(spark, d):
    return stepped(spark, d, S.edge_step(50.0), (0, False), "n long, high boolean", "count long")


@query(f"WITH a AS (SELECT *, coalesce(last_value(CASE WHEN value >= 80 THEN true WHEN value <= 20 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS alarm FROM events) SELECT user_id, event_id, alarm FROM a {W} QUALIFY alarm <> coalesce(lag(alarm) OVER w, false)")
def stream_alarm(spark, d):
    return stepped(spark, d, S.alarm_step(80.0, 20.0), (False,), "on boolean", "alarm boolean")


@query("WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT event_id, user_id, i, greatest(-5.0::double, least(5.0::double, value)) AS v FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.i, r.v + greatest(-5.0::double, least(5.0::double, e.value - r.v)) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id, round(v, 6) AS value FROM r")
def stream_slew(spark, d):
    return stepped(spark, d, S.slew_step(5.0), (0.0,), "held double", "value double").withColumn("value", F.round("value", 6))


@query(f"SELECT user_id, event_id, round(0.5 * (50 - value) + 0.1 * sum(50 - value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 0.2 * ((50 - value) - coalesce(lag(50 - value) OVER w, 0)), 4) AS answer FROM events {W}")
def stream_pid(spark, d):
    return stepped(spark, d, S.pid_step(50.0, 0.5, 0.1, 0.2), (0.0, 0.0), "total double, last double", "answer double").withColumn("answer", F.round("answer", 4))


@query(f"WITH m AS (SELECT *, sum((NOT value > 50)::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) SELECT user_id, event_id, value > 50 AND sum((value > 50)::int) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 3 AS running FROM m")
def stream_timer(spark, d):
    return stepped(spark, d, S.timer_step(3), (0,), "held long", "running boolean")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_fold(spark, d):
    out = stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return ended(out, "complete")
