"""Scaling, metrics, models, arrays and rasters."""

from pyspark.sql import functions as F

from ..operators import arrays as R
from ..operators import learning as L
from ..registry import query, table


def r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def scale_standard(spark, d):
    return r(L.standard_scale(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]), 6, "p_retailprice")


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def scale_min_max(spark, d):
    return r(L.min_max_scale(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]), 6, "p_retailprice")


@query("SELECT c_custkey, round(c_acctbal / max(abs(c_acctbal)) OVER (), 6) AS c_acctbal FROM customer")
def scale_max_abs(spark, d):
    return r(L.max_abs_scale(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), 6, "c_acctbal")


@query("SELECT c_custkey, round((c_acctbal - m) / (b - a), 6) AS c_acctbal FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) AS b FROM customer)")
def scale_robust(spark, d):
    return r(L.robust_scale(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), 6, "c_acctbal")


@query("SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def encode_labels(spark, d):
    return L.label_codes(table(spark, d, "part"), "p_brand")


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::int AS l_returnflag_A, (l_returnflag = 'N')::int AS l_returnflag_N FROM lineitem")
def encode_one_hot(spark, d):
    return L.one_hot(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["A", "N"]).drop("l_returnflag")


@query("SELECT c_custkey, ((c_acctbal >= a)::int + (c_acctbal >= b)::int + (c_acctbal >= c)::int) AS c_acctbal_bin FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)")
def encode_quantile_bins(spark, d):
    return L.quantile_bins(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 4).drop("c_acctbal")


@query("SELECT p_partkey, round(coalesce(nullif(p_size, 7)::double, (SELECT avg(nullif(p_size, 7)) FROM part)), 6) AS s FROM part")
def impute_mean(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).cast("double").alias("s"))
    return r(L.impute(df, ["s"]), 6, "s")


@query("SELECT l_orderkey, l_linenumber, round(ln(l_quantity) - (ln(l_quantity) + ln(l_extendedprice) + ln(l_linenumber)) / 3, 6) AS clr_l_quantity, round(ln(l_quantity / l_linenumber), 6) AS alr_l_quantity, round(sqrt(0.5) * (ln(l_quantity) - ln(l_extendedprice)), 6) AS ilr_1 FROM lineitem")
def log_ratios(spark, d):
    c = ["l_quantity", "l_extendedprice", "l_linenumber"]
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", L.clr(c)["clr_l_quantity"].alias("clr_l_quantity"), L.alr(c)["alr_l_quantity"].alias("alr_l_quantity"), L.ilr(c)[0])
    return r(out, 6, "clr_l_quantity", "alr_l_quantity", "ilr_1")


CLASSES = "WITH p AS (SELECT quality AS t, (doc_id % 3 = 0)::int AS g FROM labels), c AS (SELECT sum((t = 1 AND g = 1)::int)::double AS tp, sum((t <> 1 AND g = 1)::int)::double AS fp, sum((t = 1 AND g <> 1)::int)::double AS fn, sum((t <> 1 AND g <> 1)::int)::double AS tn FROM p), k AS (SELECT *, tp + fp + fn + tn AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (tp + fp + fn + tn) ** 2 AS chance FROM c) "


@query(CLASSES + "SELECT round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(((tp + tn) / n - chance) / (1 - chance), 6) AS kappa, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced FROM k")
def metrics_of_classes(spark, d):
    df = table(spark, d, "labels").select(F.col("quality").alias("t"), (F.col("doc_id") % 3 == 0).cast("int").alias("g"))
    out = L.binary_metrics(df, "t", "g")
    return r(out, 6, *out.columns)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def metrics_confusion(spark, d):
    return L.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("WITH e AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS g FROM lineitem) SELECT round(avg((t - g) ** 2), 2) AS mse, round(sqrt(avg((t - g) ** 2)), 4) AS rmse, round(avg(abs(t - g)), 4) AS mae, round(avg(abs((t - g) / t)), 6) AS mape, round(1 - sum((t - g) ** 2) / (var_pop(t) * count(t)), 6) AS r2, round(1 - var_pop(t - g) / var_pop(t), 6) AS explained FROM e")
def metrics_of_regression(spark, d):
    out = L.regression_metrics(table(spark, d, "lineitem").withColumn("g", F.col("l_quantity") * 1500), "l_extendedprice", "g")
    return r(r(r(out, 2, "mse"), 4, "rmse", "mae"), 6, "mape", "r2", "explained")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def regression_fit(spark, d):
    w = L.linear_fit(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.range(1).select(F.round(F.lit(w["l_quantity"]), 4).alias("slope"), F.round(F.lit(w["1"]), 2).alias("intercept"))


@query("WITH f AS (SELECT l_orderkey % 3 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), w AS (SELECT k, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f, range(3) t(k) WHERE fold <> k GROUP BY k) SELECT fold, count(*) AS rows, round(sqrt(avg((y - a * x - b) ** 2)), 2) AS rmse FROM f JOIN w ON k = fold GROUP BY fold")
def regression_cross_validated(spark, d):
    return r(L.cross_validate(table(spark, d, "lineitem"), F.col("l_orderkey") % 3, 3, ["l_quantity"], "l_extendedprice"), 2, "rmse")


@query()
def split_by_group(spark, d):
    train, test = L.train_test(table(spark, d, "customer"), "c_custkey", 0.2)
    return train.select("c_custkey", F.lit("train").alias("part"), L.fold_of(F.col("c_nationkey"), 5).alias("fold")).unionByName(test.select("c_custkey", F.lit("test").alias("part"), L.fold_of(F.col("c_nationkey"), 5).alias("fold")))


def vectors(spark, d):
    from pyspark.ml.functions import array_to_vector

    return table(spark, d, "embeddings").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


@query()
def cluster_kmeans(spark, d):
    df = vectors(spark, d)
    return L.estimator("kmeans", k=10, seed=1, maxIter=20).fit(df).transform(df).select("vec_id", "label", F.col("prediction").alias("cluster"))


@query()
def decompose_pca(spark, d):
    df = vectors(spark, d)
    from pyspark.ml.functions import vector_to_array

    out = L.estimator("pca", k=3, inputCol="features", outputCol="p").fit(df).transform(df)
    return out.select("vec_id", F.transform(vector_to_array("p"), lambda x: F.round(F.abs(x), 6)).alias("components"))


@query()
def classify_logistic(spark, d):
    df = vectors(spark, d).withColumn("label", (F.col("label") < 5).cast("double"))
    return L.estimator("logistic", maxIter=20).fit(df).transform(df).select("vec_id", "label", "prediction")


@query()
def classify_forest(spark, d):
    df = vectors(spark, d).withColumn("label", F.col("label").cast("double"))
    return L.estimator("forest", numTrees=10, seed=1).fit(df).transform(df).select("vec_id", "label", "prediction")


@query()
def nearest_neighbours(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return L.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 3)


GRID = "SELECT o_orderkey // 40 AS i, o_orderkey % 40 AS j, any_value(o_totalprice) AS v FROM orders GROUP BY 1, 2"


def grid(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 40).alias("i"), (F.col("o_orderkey") % 40).alias("j"), F.col("o_totalprice").alias("v"))


@query(f"WITH g AS ({GRID}) SELECT i, round(sum(v), 2) AS v FROM g GROUP BY i")
def array_reduce(spark, d):
    return r(R.reduce_axis(grid(spark, d), "i", F.sum), 2, "v")


@query(f"WITH g AS (SELECT i, j, v / 1000 AS v FROM ({GRID})) SELECT a.j AS i, b.j, round(sum(a.v * b.v), 2) AS v FROM g a JOIN g b ON a.i = b.i GROUP BY 1, 2")
def array_matmul(spark, d):
    g = grid(spark, d).withColumn("v", F.col("v") / 1000)
    return r(R.matmul(R.transpose(g), g), 2, "v")


@query(f"WITH g AS ({GRID}) SELECT round(sqrt(sum(v * v)), 2) AS norm, round(sum(CASE WHEN i = j THEN v END), 2) AS trace FROM g")
def array_norm_trace(spark, d):
    g = grid(spark, d)
    return r(R.norm(g).crossJoin(R.trace(g)), 2, "norm", "trace")


def smooth(spark):
    return spark.range(2500).select(F.floor(F.col("id") / 50).cast("long").alias("i"), (F.col("id") % 50).alias("j")).withColumn("v", F.col("i") * F.col("i") * 0.5 + F.col("j") * 3.0 + (F.col("i") * F.col("j")) % 7)


SMOOTH = "g AS (SELECT id // 50 AS i, id % 50 AS j, (id // 50) * (id // 50) * 0.5 + (id % 50) * 3.0 + ((id // 50) * (id % 50)) % 7 AS v FROM range(0, 2500) t(id)), w AS (SELECT c.i, c.j, c.v, max(n.v) FILTER (n.i = c.i - 1 AND n.j = c.j - 1) AS a, max(n.v) FILTER (n.i = c.i - 1 AND n.j = c.j) AS b, max(n.v) FILTER (n.i = c.i - 1 AND n.j = c.j + 1) AS c_, max(n.v) FILTER (n.i = c.i AND n.j = c.j - 1) AS d, max(n.v) FILTER (n.i = c.i AND n.j = c.j + 1) AS f, max(n.v) FILTER (n.i = c.i + 1 AND n.j = c.j - 1) AS g, max(n.v) FILTER (n.i = c.i + 1 AND n.j = c.j) AS h, max(n.v) FILTER (n.i = c.i + 1 AND n.j = c.j + 1) AS k, count(*) AS m FROM g c JOIN g n ON abs(n.i - c.i) <= 1 AND abs(n.j - c.j) <= 1 GROUP BY c.i, c.j, c.v) "


@query("WITH " + SMOOTH + "SELECT i, j, round(degrees(atan(sqrt(x * x + y * y))), 4) AS slope, round(tri, 4) AS tri, round(tpi, 4) AS tpi FROM (SELECT i, j, ((c_ + 2 * f + k) - (a + 2 * d + g)) / 8 AS x, ((g + 2 * h + k) - (a + 2 * b + c_)) / 8 AS y, sqrt((a - v) ** 2 + (b - v) ** 2 + (c_ - v) ** 2 + (d - v) ** 2 + (f - v) ** 2 + (g - v) ** 2 + (h - v) ** 2 + (k - v) ** 2) AS tri, v - (a + b + c_ + d + f + g + h + k) / 8 AS tpi FROM w WHERE m = 9)")
def raster_terrain(spark, d):
    out = R.terrain(smooth(spark)).where("tpi is not null").select("i", "j", "slope", "tri", "tpi")
    return r(out, 4, "slope", "tri", "tpi")


@query()
def raster_flow(spark, d):
    return R.accumulation(R.flow_direction(smooth(spark)))


@query("WITH " + SMOOTH + "SELECT i, j, 'down' AS edge, round(i + (300 - v) / (h - v), 6) AS y, j::double AS x FROM w WHERE (v < 300) <> (h < 300) UNION ALL SELECT i, j, 'right', i::double, round(j + (300 - v) / (f - v), 6) FROM w WHERE (v < 300) <> (f < 300)")
def raster_contour(spark, d):
    out = R.contour_crossings(smooth(spark), 300.0)
    return out.select("i", "j", "edge", F.round(F.col("y").cast("double"), 6).alias("y"), F.round(F.col("x").cast("double"), 6).alias("x"))
