"""Running and adjacent computations, and spreadsheet lookups."""

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import windows as W
from ..registry import query, table

K, O = ["user_id"], ["ts", "event_id"]


@query("SELECT event_id, round(sum(coalesce(v, 0)) OVER w, 4) AS total, round(v - lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_and_difference(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return df.select("event_id", F.round(W.cumulative_sum(F.col("v"), K, O), 4).alias("total"), F.round(W.difference(F.col("v"), K, O), 6).alias("step"))


@query("SELECT event_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def rolling_window(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", F.round(W.rolling(F.col("value"), 5, F.avg, K, O), 6).alias("mean"), W.rolling(F.col("value"), 5, F.max, K, O).alias("high"))


@query("WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT event_id, user_id, i, value * 0.1::double AS s FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.i, r.s * 0.9::double + e.value * 0.1::double FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT event_id, round(s, 6) AS smooth FROM r")
def running_fold(spark, d):
    df = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return W.fold(df, "value", 0.0, lambda a, x: a * 0.9 + x * 0.1, K, O, "s").select("event_id", F.round("s", 6).alias("smooth"))


@query("WITH m AS (SELECT *, coalesce((event_type <> lag(event_type) OVER w)::int, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m) SELECT user_id, any_value(event_type) AS event_type, min(ts) AS first, max(ts) AS last, count(*) AS length FROM r GROUP BY user_id, run")
def adjacent_runs(spark, d):
    return W.runs(table(spark, d, "events"), "event_type", K, O)


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::double AS r FROM part")
def average_ranks(spark, d):
    return W.with_average_rank(table(spark, d, "part"), "p_size", "r").select("p_partkey", F.col("r").cast("double").alias("r"))


@query("WITH a AS (SELECT *, value > 50 AS t, event_type = 'signup' AS r FROM events), b AS (SELECT *, (t AND NOT coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id), false)) AS e, sum(r::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM a) SELECT event_id, (sum(CASE WHEN r THEN 0 ELSE e::int END) OVER (PARTITION BY user_id, p ORDER BY ts, event_id))::bigint AS count FROM b")
def edges_since_reset(spark, d):
    return W.edge_counter(table(spark, d, "events"), F.col("value") > 50, F.col("event_type") == "signup", K, O).select("event_id", "count")


@query("WITH a AS (SELECT *, event_type = 'click' AS t FROM events), b AS (SELECT *, t AND NOT coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS e FROM a) SELECT event_id, last_value(CASE WHEN e THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held, coalesce(last_value(CASE WHEN value >= 80 THEN true WHEN value <= 20 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS alarm FROM b")
def hold_and_alarm(spark, d):
    df = table(spark, d, "events").withColumn("e", W.rising(F.col("event_type") == "click", K, O))
    return df.select("event_id", W.sample_and_hold(F.col("value"), F.col("e"), K, O).alias("held"), W.alarm(F.col("value"), 80, 20, K, O).alias("alarm"))


@query("SELECT event_id, o_orderkey FROM events ASOF LEFT JOIN (SELECT o_custkey, o_orderkey % 31 + 1 AS day, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON user_id = o_custkey AND extract(day FROM ts) >= day")
def asof_lookup(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", F.dayofmonth("ts").cast("long").alias("day"))
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 31 + 1).alias("day")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return I.asof(events, orders, ["user_id"], "day", ["o_orderkey"]).select("event_id", "o_orderkey")
