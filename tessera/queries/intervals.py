"""Intervals: suppliers and parts as holes, events as intervals in time."""

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..registry import query, table

#: Intervals of a user's line in whole steps: from, to, value.
EVENTS = "WITH e AS (SELECT user_id AS hole, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), a AS (SELECT hole, event_id, event_type, value, (i * 2 + event_id % 2)::double AS f, (i * 2 + 2 + event_id % 2)::double AS t FROM e), b AS (SELECT o_custkey AS hole, o_orderkey, o_orderstatus AS code, ((o_orderkey % 7) * 9)::double AS f, ((o_orderkey % 7) * 9 + 5)::double AS t FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderkey) = 1) "


def sides(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select(F.col("user_id").alias("hole"), "event_id", "event_type", "value", i.alias("i"))
    a = e.select("hole", "event_id", "event_type", "value", (F.col("i") * 2 + F.col("event_id") % 2).cast("double").alias("f"), (F.col("i") * 2 + 2 + F.col("event_id") % 2).cast("double").alias("t"))
    o = table(spark, d, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey", F.col("o_orderkey") % 7).orderBy("o_orderkey"))).where("r = 1")
    b = o.select(F.col("o_custkey").alias("hole"), "o_orderkey", F.col("o_orderstatus").alias("code"), ((F.col("o_orderkey") % 7) * 9).cast("double").alias("f"), ((F.col("o_orderkey") % 7) * 9 + 5).cast("double").alias("t"))
    return a, b


@query(EVENTS + "SELECT event_id, CASE WHEN f < bt THEN code END AS code FROM (SELECT a.*, b.t AS bt, b.code FROM a ASOF LEFT JOIN b ON a.hole = b.hole AND a.f >= b.f)")
def interval_lookup(spark, d):
    a, b = sides(spark, d)
    return I.covering(a.select("hole", "event_id", F.col("f").alias("x")), b.withColumnRenamed("f", "s").withColumnRenamed("t", "e"), ["hole"], "x", "s", "e", ["code"]).select("event_id", "code")


@query(EVENTS + "SELECT event_id, o_orderkey, least(a.t, b.t) - greatest(a.f, b.f) AS overlap FROM a JOIN b ON a.hole = b.hole AND a.f < b.t AND a.t > b.f")
def interval_overlaps(spark, d):
    a, b = sides(spark, d)
    return I.overlaps(a, b, "hole", ("f", "t"), ("f", "t"), 16.0).select("event_id", F.col("r_o_orderkey").alias("o_orderkey"), "overlap")


@query(EVENTS + ", p AS (SELECT DISTINCT hole, x FROM (SELECT hole, unnest([f, t]) AS x FROM a UNION ALL SELECT hole, unnest([f, t]) FROM b)), s AS (SELECT hole, x AS f, lead(x) OVER (PARTITION BY hole ORDER BY x) AS t FROM p), m AS (SELECT *, (f + t) / 2 AS mid FROM s WHERE t IS NOT NULL), one AS (SELECT m.hole, m.f, m.t, m.mid, CASE WHEN mid < a.t THEN a.value END AS value, CASE WHEN mid < a.t THEN true END AS ia FROM m ASOF LEFT JOIN a ON m.hole = a.hole AND m.mid >= a.f), two AS (SELECT one.hole, one.f, one.t, one.value, ia, CASE WHEN mid < b.t THEN b.code END AS code, CASE WHEN mid < b.t THEN true END AS ib FROM one ASOF LEFT JOIN b ON one.hole = b.hole AND one.mid >= b.f) SELECT hole, f, t, value, code FROM two WHERE ia OR ib")
def interval_union(spark, d):
    a, b = sides(spark, d)
    # a user's own steps may leave gaps or overlap by one; the as-of rule is the same on both sides
    return I.segments(a.select("hole", "f", "t", "value"), b.select("hole", "f", "t", "code"), "hole", "f", "t")


@query("WITH e AS (SELECT user_id AS hole, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), w AS (SELECT hole, i // 4 AS w, i, value FROM e) SELECT hole, (w * 4)::double AS f, (max(i) + 1)::double AS t, count(*)::double AS support, round(avg(value), 6) AS value, count(*)::double AS value_support FROM w GROUP BY hole, w")
def composite_fixed_length(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, d, "events").select(F.col("user_id").alias("hole"), "value", i.cast("double").alias("f"))
    out = I.composite(e.withColumn("t", F.col("f") + 1), "hole", "f", "t", 4.0, [], ["value"])
    return out.withColumn("value", F.round("value", 6))


@query("WITH e AS (SELECT user_id AS hole, event_type AS g, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), n AS (SELECT *, coalesce((g <> lag(g) OVER (PARTITION BY hole ORDER BY i))::int, 1) AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY hole ORDER BY i) AS run FROM n), o AS (SELECT *, i - min(i) OVER (PARTITION BY hole, run) AS k, min(i) OVER (PARTITION BY hole, run) AS s FROM r) SELECT hole, (s + k // 2 * 2)::double AS f, count(*)::double AS support, round(avg(value), 6) AS value, any_value(g) AS g FROM o GROUP BY hole, run, s, k // 2")
def composite_by_category(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, d, "events").select(F.col("user_id").alias("hole"), F.col("event_type").alias("g"), "value", i.cast("double").alias("f"))
    out = I.composite(e.withColumn("t", F.col("f") + 1), "hole", "f", "t", 2.0, ["g"], ["value"], ["g"])
    return out.select("hole", "f", "support", F.round("value", 6).alias("value"), "g")


QA = "WITH o AS (SELECT o_custkey AS hole, o_orderkey, (o_orderkey % 50)::double AS f, (o_orderkey % 50 + o_orderkey % 9 - 1)::double AS t FROM orders), w AS (SELECT *, lag(t) OVER (PARTITION BY hole ORDER BY f, t) AS p FROM o), c AS (SELECT hole, 'inverted' AS \"check\" FROM w WHERE t < f UNION ALL SELECT hole, 'empty' FROM w WHERE t = f UNION ALL SELECT hole, 'gap' FROM w WHERE f - p > 1e-9 UNION ALL SELECT hole, 'overlap' FROM w WHERE p - f > 1e-9) "


@query(QA + "SELECT \"check\", count(*) AS n, count(DISTINCT hole) AS holes FROM c GROUP BY 1")
def interval_checks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("hole"), "o_orderkey", (F.col("o_orderkey") % 50).cast("double").alias("f"), (F.col("o_orderkey") % 50 + F.col("o_orderkey") % 9 - 1).cast("double").alias("t"))
    return I.summary(I.findings(o, "hole", "f", "t"), "hole")


@query()
def survey_traces(spark, d):
    collars = table(spark, d, "supplier").select(F.col("s_suppkey").alias("hole"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"), F.lit(100.0).alias("z"))
    surveys = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_suppkey").alias("hole"), (F.col("l_partkey") % 40 * 10).cast("double").alias("depth"), (F.col("l_quantity") * 7).alias("az"), (F.col("l_quantity") + 35).alias("dip"))
    out = I.traces(collars, surveys, "hole", "depth", "az", "dip")
    return out.select("hole", "depth", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "dogleg")])


@query("WITH c AS (SELECT p_size AS i, avg(p_retailprice) AS v FROM part GROUP BY 1), e AS (SELECT i, v, unnest(range((i * 3) // 5, ceil((i + 1) * 3 / 5.0)::int)) AS t FROM c) SELECT t AS i, round(sum(v * o) / sum(o), 6) AS v, round(sum(o) / 5.0, 6) AS coverage FROM (SELECT *, least((i + 1) * 3, t * 5 + 5) - greatest(i * 3, t * 5) AS o FROM e) GROUP BY 1")
def grid_resampling(spark, d):
    cells = table(spark, d, "part").groupBy(F.col("p_size").alias("i")).agg(F.avg("p_retailprice").alias("v"))
    out = I.grid_resample(cells, ["i"], 3.0, 5.0, "v")
    return out.select(F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"), F.round("coverage", 6).alias("coverage"))
