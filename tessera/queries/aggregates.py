"""Statistics over the test tables."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..registry import query, table


def rounded(df, /, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("SELECT event_type, count(value) AS n, sum((value = 0)::int)::bigint AS zeros, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 4) AS std, round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis FROM events GROUP BY 1")
def moments_bias_corrected(spark, d):
    out = table(spark, d, "events").groupBy("event_type").agg(A.moments(F.col("value")).alias("m")).select("event_type", "m.*")
    return rounded(out, mean=4, variance=4, std=4, skewness=4, kurtosis=4)


@query("SELECT event_type, round(avg(value), 4) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY 1")
def moments_population(spark, d):
    out = table(spark, d, "events").groupBy("event_type").agg(A.population_moments(F.col("value")).alias("m")).select("event_type", "m.mean", "m.variance")
    return rounded(out, mean=4, variance=4)


@query("WITH m AS (SELECT l_returnflag AS f, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean, sum(l_quantity) AS w, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, any_value(m.n) AS n, any_value(w) AS sum_w, round(any_value(mean), 4) AS mean, round(sum(l_quantity * (l_extendedprice - mean) ** 2) / (any_value(w) - 1), 2) AS variance FROM lineitem JOIN m ON f = l_returnflag GROUP BY 1")
def weighted_statistics(spark, d):
    return rounded(A.weighted(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"), mean=4, variance=2)


@query("WITH a AS (SELECT l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY 1), p AS (SELECT v, (sum(w) OVER (ORDER BY v) - w / 2) / sum(w) OVER () AS p FROM a), n AS (SELECT v, p, lead(v) OVER (ORDER BY v) AS v2, lead(p) OVER (ORDER BY v) AS p2 FROM p) SELECT q, round(v + (v2 - v) * (q - p) / (p2 - p), 6) AS value FROM n, (SELECT unnest([0.25, 0.5, 0.9]::double[]) AS q) WHERE p <= q AND q < p2")
def weighted_quantiles(spark, d):
    out = A.weighted_quantiles(table(spark, d, "lineitem"), "l_quantity", "l_linenumber", [0.25, 0.5, 0.9])
    return out.select(F.col("q").cast("double").alias("q"), F.col("value").cast("double").alias("value")).withColumns({"value": F.round("value", 6)})


@query("SELECT l_quantity, (sum(n) OVER (ORDER BY l_quantity))::double / (sum(n) OVER ())::double AS share FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)")
def empirical_distribution(spark, d):
    return A.ecdf(table(spark, d, "lineitem"), "l_quantity")


@query("SELECT bin, n, weight, sum(weight) OVER (ORDER BY bin DESC) AS from_top FROM (SELECT CASE WHEN l_quantity < 5 THEN -1 WHEN l_quantity >= 45 THEN 10 ELSE least(floor((l_quantity - 5) / 4.0)::int, 9) END AS bin, count(*) AS n, count(*)::double AS weight FROM lineitem GROUP BY 1)")
def histogram_cumulative(spark, d):
    return A.histogram(table(spark, d, "lineitem"), "l_quantity", 5, 45, 10)


@query("SELECT least(floor((p_size - a) / ((b - a) / 7.0)), 6)::int AS bin, count(*) AS n, min(p_size) AS low, max(p_size) AS high FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part) GROUP BY 1")
def bins_of_equal_width(spark, d):
    return A.equal_bins(table(spark, d, "part"), "p_size", 7)


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5")
def top_categories(spark, d):
    return A.top_k(table(spark, d, "part"), "p_type", 5)


@query("SELECT c AS cutoff, sum(l_quantity) AS tonnes, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS grade FROM lineitem, (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08]::double[]) AS c) WHERE l_discount >= c AND l_quantity > 0 GROUP BY c")
def grade_and_tonnage(spark, d):
    return rounded(A.grade_tonnage(table(spark, d, "lineitem"), "l_discount", "l_quantity", [0.0, 0.02, 0.04, 0.06, 0.08]), grade=6)


@query("SELECT floor((l_quantity * 0.5::double + l_linenumber * 0.25::double) / 5)::bigint AS slice, count(*) AS n, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1")
def swath_means(spark, d):
    return rounded(A.swath(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"], [0.5, 0.25], 0.0, 5.0, "l_discount", "l_extendedprice"), mean=6)


@query("SELECT coalesce(nullif(l_returnflag, 'N'), '—') AS key, ((l_discount >= 0.03)::int + (l_discount >= 0.07)::int) AS class, sum(l_quantity) AS weight, round(sum(l_quantity * l_discount), 4) AS metal, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab_classes(spark, d):
    df = table(spark, d, "lineitem").withColumn("f", F.nullif("l_returnflag", F.lit("N")))
    return rounded(A.crosstab(df, "f", "l_discount", [0.03, 0.07], "l_quantity"), metal=4)


@query("SELECT floor(l_quantity / 5.0)::bigint AS i, floor(l_discount / 0.02)::bigint AS j, count(*) AS n FROM lineitem GROUP BY 1, 2")
def density_grid(spark, d):
    return A.density(table(spark, d, "lineitem"), "l_quantity", "l_discount", 5.0, 0.02)


@query("SELECT (floor(p_size / 10.0) + 0.5) * 10 AS center, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1")
def binned_aggregates(spark, d):
    return rounded(A.binned(table(spark, d, "part"), "p_size", 10.0, {"n": F.count(F.lit(1)), "price": F.avg("p_retailprice")}), price=4)


@query("SELECT count(*) AS n, round(sum(l_extendedprice * l_quantity), 1) AS ws, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS wm, min(l_tax) AS low, max(l_tax) AS high, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def aggregates_from_spec(spark, d):
    spec = {"n": {"op": "count"}, "ws": {"op": "sum", "col": "l_extendedprice", "weight": "l_quantity"}, "wm": {"op": "mean", "col": "l_discount", "weight": "l_quantity"}, "low": {"op": "min", "col": "l_tax"}, "high": {"op": "max", "col": "l_tax"}, "suppliers": {"op": "cardinality", "col": "l_suppkey"}}
    return rounded(table(spark, d, "lineitem").agg(*A.from_spec(spec)), ws=1, wm=6)


@query("SELECT round(exp(avg(ln(p_retailprice))), 4) AS geometric, round(count(*) / sum(1 / p_retailprice), 4) AS harmonic FROM part")
def special_means(spark, d):
    return rounded(table(spark, d, "part").agg(A.geometric_mean(F.col("p_retailprice")).alias("geometric"), A.harmonic_mean(F.col("p_retailprice")).alias("harmonic")), geometric=4, harmonic=4)


@query("WITH s AS (SELECT avg(value) FILTER (event_type = 'click') AS m0, var_samp(value) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'click') AS v0, count(*) FILTER (event_type = 'click') AS n0, avg(value) FILTER (event_type = 'view') AS m1, var_samp(value) FILTER (event_type = 'view') / count(*) FILTER (event_type = 'view') AS v1, count(*) FILTER (event_type = 'view') AS n1 FROM events) SELECT round((m0 - m1) / sqrt(v0 + v1), 6) AS t, round((v0 + v1) ** 2 / (v0 ** 2 / (n0 - 1) + v1 ** 2 / (n1 - 1)), 4) AS df FROM s")
def welch_test(spark, d):
    return rounded(A.welch_t(table(spark, d, "events"), "value", "event_type", "click", "view"), t=6, df=4)


@query("WITH t AS (SELECT CASE WHEN p_size = 7 THEN NULL WHEN p_size = 8 THEN 0.0 WHEN p_size = 9 THEN NULL ELSE p_size::double END AS v, (p_size = 7)::int AS null_, (p_size = 9)::int AS bad FROM part), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM t WHERE v IS NOT NULL) SELECT count(*) AS count, count(v) AS n, sum(null_)::bigint AS nulls, sum(bad)::bigint AS bad, sum((v = 0)::int)::bigint AS zeros, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(stddev_samp(v) / avg(v), 6) AS cv, min(v) AS min, max(v) AS max, (SELECT v FROM r WHERE i = floor((n - 1) * 0.25 + 0.5)) AS q25, (SELECT v FROM r WHERE i = floor((n - 1) * 0.5 + 0.5)) AS q50, (SELECT v FROM r WHERE i = floor((n - 1) * 0.75 + 0.5)) AS q75 FROM t")
def column_profile(spark, d):
    text = F.when(F.col("p_size") == 7, " NA ").when(F.col("p_size") == 8, "0").when(F.col("p_size") == 9, "oops").otherwise(F.col("p_size").cast("string"))
    return rounded(A.profile(table(spark, d, "part").select(text.alias("t")), "t").drop("skew"), mean=6, std=6, cv=6)


@query("WITH t AS (SELECT coalesce(nullif(p_brand, 'Brand#11'), '(blank)') AS key, p_retailprice AS v, p_size AS w FROM part) SELECT coalesce(key, '(total)') AS key, count(v) AS n, round(sum(v), 2) AS sum, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std, round(sum(v * w) / sum(w), 4) AS wmean FROM t GROUP BY GROUPING SETS ((key), ())")
def groups_with_total(spark, d):
    df = table(spark, d, "part").withColumn("b", F.nullif("p_brand", F.lit("Brand#11")))
    return rounded(A.group_with_total(df, "b", "p_retailprice", "p_size"), sum=2, mean=4, std=4, wmean=4)


@query("SELECT 't' AS column, 'blank' AS issue, count(*) AS n FROM part WHERE p_size = 1 UNION ALL SELECT 't', 'leading_zero', count(*) FROM part WHERE p_size = 2 UNION ALL SELECT 't', 'sentinel', count(*) FROM part WHERE p_size = 3 UNION ALL SELECT 't', 'thousands', count(*) FROM part WHERE p_size = 4 UNION ALL SELECT 't', 'date_text', count(*) FROM part WHERE p_size = 5 UNION ALL SELECT 't', 'not_numeric', count(*) FROM part WHERE p_size IN (4, 5)")
def data_quality_scan(spark, d):
    odd = {1: " ", 2: "007", 3: "-999", 4: "1,234", 5: "2024-01-31"}
    t = F.col("p_size").cast("string")
    for k, v in odd.items():
        t = F.when(F.col("p_size") == k, v).otherwise(t)
    return A.quality_scan(table(spark, d, "part").select(t.alias("t")), ["t"])


@query("SELECT CASE WHEN i < 0.005 THEN 'below' WHEN i < 0.5 THEN 'number' WHEN i < 0.6 THEN 'above' ELSE 'blank' END AS kind, count(*) AS n, round(sum(CASE WHEN i < 0.005 THEN 0.005 WHEN i < 0.5 THEN round(i, 4) WHEN i < 0.6 THEN 10 END), 3) AS total FROM (SELECT value / 1000 AS i FROM events) GROUP BY 1")
def qualified_numbers(spark, d):
    from ..functions import blanks as B

    i = F.col("value") / 1000
    t = F.when(i < 0.005, "<0.01").when(i < 0.5, F.round(i, 4).cast("decimal(10,4)").cast("string")).when(i < 0.6, ">10").otherwise(" ")
    df = table(spark, d, "events").select(t.alias("t"))
    return df.groupBy(B.qualified_kind(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(B.qualified(F.col("t"))), 3).alias("total"))


@query("WITH s AS (SELECT s_suppkey, s_acctbal AS x, s_nationkey * 100.0 AS y, o FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS o)), c AS (SELECT *, floor((x + o * 250) / 1000) AS a, floor((y + o * 250) / 1000) AS b FROM s), k AS (SELECT o, a, b, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT o, count(*) AS cells FROM k GROUP BY o) SELECT s_suppkey, round(avg(1.0 / (n * cells)) * (SELECT count(*) FROM supplier), 6) AS weight FROM c JOIN k USING (o, a, b) JOIN m USING (o) GROUP BY 1")
def declustering_weights(spark, d):
    df = table(spark, d, "supplier").withColumn("y", F.col("s_nationkey") * 100.0)
    return rounded(A.decluster(df, ["s_acctbal", "y"], "s_suppkey", 1000.0), weight=6)


@query("SELECT floor(h / 250)::int AS class, count(*) AS pairs, round(avg(h), 4) AS distance, round(avg(v) / 2, 2) AS gamma FROM (SELECT sqrt((a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey * 100 - b.s_nationkey * 100) ** 2) AS h, (a.s_acctbal - b.s_acctbal) ** 2 AS v FROM supplier a, supplier b WHERE a.s_suppkey < b.s_suppkey) WHERE h > 0 AND h < 1000 GROUP BY 1")
def experimental_variogram(spark, d):
    df = table(spark, d, "supplier").withColumn("y", F.col("s_nationkey") * 100.0)
    return rounded(A.variogram(df, "s_suppkey", ["s_acctbal", "y"], "s_acctbal", 250.0, 4), distance=4, gamma=2)
