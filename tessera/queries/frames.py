"""Projection, joins, groups, shape and order."""

from pyspark.sql import functions as F

from ..operators import frame
from ..registry import query, table


@query("SELECT l_orderkey AS okey, l_linenumber AS line, l_quantity * l_extendedprice AS amount FROM lineitem")
def select_rename_derive(spark, d):
    df = frame.derive(table(spark, d, "lineitem"), {"amount": F.col("l_quantity") * F.col("l_extendedprice")})
    return df.withColumnsRenamed({"l_orderkey": "okey", "l_linenumber": "line"}).select("okey", "line", "amount")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (3, 5, 7)")
def drop_rows_by_label(spark, d):
    return frame.drop_rows(table(spark, d, "supplier"), "s_nationkey", [3, 5, 7]).drop("s_nationkey", "s_acctbal")


@query("SELECT c_custkey, c_acctbal * 2 AS twice, c_acctbal * 2 + 1 AS more FROM customer")
def assign_in_sequence(spark, d):
    return frame.assign(table(spark, d, "customer"), {"twice": F.col("c_acctbal") * 2, "more": F.col("twice") + 1}).select("c_custkey", "twice", "more")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, false)")
def mask_complement(spark, d):
    return table(spark, d, "customer").where(frame.complement(F.nullif("c_nationkey", F.lit(3)) > 10)).select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders")
def choose(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "big").otherwise("small").alias("size"))


@query("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL OR c_mktsegment = 'MACHINERY'")
def is_in_with_null(spark, d):
    return table(spark, d, "customer").where(frame.is_in(F.nullif("c_mktsegment", F.lit("BUILDING")), ["MACHINERY", None])).select("c_custkey")


@query("SELECT sum((nullif(p_size, 7) IS NULL)::int)::bigint AS p_size, sum((p_brand IS NULL)::int)::bigint AS p_brand FROM part")
def missing_values(spark, d):
    df = table(spark, d, "part").select(F.nullif("p_size", F.lit(7)).alias("p_size"), "p_brand")
    return frame.missing(df).agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in df.columns])


@query("SELECT p_partkey, p_size FROM part WHERE p_size <> 7")
def drop_missing(spark, d):
    return table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size")).dropna(subset=["p_size"])


@query("SELECT p_partkey, coalesce(nullif(p_size, 7), -1) AS p_size, p_brand FROM part")
def fill_missing(spark, d):
    return frame.fill(table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size"), "p_brand"), -1).withColumn("p_partkey", F.col("p_partkey"))


@query("SELECT p_partkey, try_cast(regexp_extract(p_brand, '[0-9]+') AS double) AS brand, cast(p_size AS varchar) AS size FROM part")
def as_type(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).try_cast("double").alias("brand"), F.col("p_size").cast("string").alias("size"))


JOIN_SQL = "WITH a AS (SELECT s_suppkey, nullif(s_nationkey, 4) AS k FROM supplier), b AS (SELECT nullif(n_nationkey, 4) AS k, n_name FROM nation WHERE n_nationkey < 12) "


def sides(spark, d):
    a = table(spark, d, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(4)).alias("k"))
    return a, table(spark, d, "nation").where("n_nationkey < 12").select(F.nullif("n_nationkey", F.lit(4)).alias("k"), "n_name")


@query(JOIN_SQL + "SELECT s_suppkey, a.k, n_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def join_inner_null_safe(spark, d):
    a, b = sides(spark, d)
    return frame.join(a, b, "k")


@query(JOIN_SQL + "SELECT s_suppkey, a.k, n_name FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def join_left(spark, d):
    a, b = sides(spark, d)
    return frame.join(a, b, "k", "left")


@query(JOIN_SQL + "SELECT s_suppkey, a.k, n_name FROM a RIGHT JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def join_right(spark, d):
    a, b = sides(spark, d)
    return frame.join(a, b, "k", "right")


@query(JOIN_SQL + "SELECT s_suppkey, a.k, n_name FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def join_full(spark, d):
    a, b = sides(spark, d)
    return frame.join(a, b, "k", "full")


@query(JOIN_SQL + "SELECT s_suppkey, k FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.k IS NOT DISTINCT FROM b.k)")
def join_semi(spark, d):
    a, b = sides(spark, d)
    return frame.semi(a, b, "k")


@query(JOIN_SQL + "SELECT s_suppkey, k FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k IS NOT DISTINCT FROM b.k)")
def join_anti(spark, d):
    a, b = sides(spark, d)
    return frame.anti(a, b, "k")


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_on_two_names(spark, d):
    right = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return frame.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), right, ("o_custkey", "c_custkey")).drop("c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_of_small_tables(spark, d):
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) i FROM nation), b AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) i FROM region) SELECT n_name, r_name FROM a JOIN b USING (i)")
def zip_by_position(spark, d):
    return frame.zip_rows(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], table(spark, d, "region"), ["r_regionkey"]).select("n_name", "r_name")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price, round(median(l_discount), 4) AS discount, min(l_tax) AS low, max(l_tax) AS high, round(stddev_samp(l_quantity), 4) AS spread FROM lineitem GROUP BY ALL")
def group_many_operations(spark, d):
    df = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    ops = frame.OPS
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(ops["sum"]("l_quantity"), 2).alias("quantity"), F.round(ops["mean"]("l_extendedprice"), 4).alias("price"), F.round(ops["median"]("l_discount"), 4).alias("discount"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"), F.round(ops["std"]("l_quantity"), 4).alias("spread"))


@query("SELECT p_brand, sum(p_size)::bigint AS p_size, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY p_brand")
def group_keeps_names(spark, d):
    return frame.aggregate(table(spark, d, "part"), ["p_brand"], {"p_size": "sum", "p_retailprice": "mean"}).withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1")
def group_first_last(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(frame.first_of("o_totalprice", "o_orderkey").alias("first_price"), frame.last_of("o_totalprice", "o_orderkey").alias("last_price"))


@query("SELECT coalesce(stddev_samp(c_acctbal), 0) * 0 AS zero, coalesce(var_samp(c_acctbal), 0) * 0 AS zero2, count(*) AS n FROM customer WHERE c_custkey = 1")
def spread_of_one_row(spark, d):
    return table(spark, d, "customer").where("c_custkey = 1").agg((frame.sample_std("c_acctbal") * 0).alias("zero"), (frame.sample_variance("c_acctbal") * 0).alias("zero2"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT nullif(p_size, 7)) + 1 AS n FROM part")
def distinct_with_null(spark, d):
    return table(spark, d, "part").select(F.nullif("p_size", F.lit(7)).alias("s")).agg(frame.distinct_values("s").alias("n"))


@query("SELECT nullif(o_orderpriority, '1-URGENT') AS priority, count(*) AS count FROM orders GROUP BY 1")
def value_counts(spark, d):
    return frame.value_counts(table(spark, d, "orders").select(F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority")), "priority")


DESCRIBE = "SELECT '{0}' AS column, count({0})::double AS count, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, min({0})::double AS min, round(quantile_cont({0}, 0.25), 4) AS q25, round(quantile_cont({0}, 0.5), 4) AS q50, round(quantile_cont({0}, 0.75), 4) AS q75, max({0})::double AS max FROM lineitem"


@query(" UNION ALL ".join(DESCRIBE.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe(spark, d):
    out = frame.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0::double UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0::double")
def correlations(spark, d):
    return frame.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("r", F.round("r", 6))


@query("SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, NULL FROM nation")
def concat_by_name(spark, d):
    a = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return frame.concat(a, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("other")))


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 4) AS l_quantity_F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 4) AS l_quantity_O, round(avg(l_tax) FILTER (l_linestatus = 'F'), 4) AS l_tax_F, round(avg(l_tax) FILTER (l_linestatus = 'O'), 4) AS l_tax_O FROM lineitem GROUP BY 1")
def pivot(spark, d):
    out = frame.pivot(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"], "mean", ["F", "O"])
    return out.withColumns({c: F.round(c, 4) for c in out.columns[1:]})


@query("SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax']) AS key, unnest([l_discount, l_tax]) AS value FROM lineitem")
def fold(spark, d):
    return frame.fold(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"])


@query("SELECT 'r_regionkey' AS column, '0' AS \"0\", '1' AS \"1\", '2' AS \"2\", '3' AS \"3\", '4' AS \"4\" UNION ALL SELECT 'r_name', (SELECT r_name FROM region WHERE r_regionkey = 0), (SELECT r_name FROM region WHERE r_regionkey = 1), (SELECT r_name FROM region WHERE r_regionkey = 2), (SELECT r_name FROM region WHERE r_regionkey = 3), (SELECT r_name FROM region WHERE r_regionkey = 4)")
def transpose(spark, d):
    return frame.transpose(table(spark, d, "region").select(F.col("r_regionkey").alias("row"), F.col("r_regionkey").cast("string").alias("r_regionkey"), "r_name"), "row")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def dedupe_keeps_first(spark, d):
    return frame.dedupe(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY nullif(s_nationkey, 4) NULLS LAST, s_acctbal DESC, s_suppkey LIMIT 30")
def sort_mixed_nulls_last(spark, d):
    df = table(spark, d, "supplier").withColumn("k", F.nullif("s_nationkey", F.lit(4)))
    return frame.ordered(df, "k", ("s_acctbal", "desc"), "s_suppkey").limit(30).select("s_suppkey", "s_nationkey", "s_acctbal")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
def head(spark, d):
    return table(spark, d, "orders").orderBy("o_orderkey").limit(5).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def tail(spark, d):
    return frame.tail(table(spark, d, "orders"), 5, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_ids(spark, d):
    return frame.with_row_id(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100 LIMIT 50")
def slice_of_rows(spark, d):
    return frame.rows_between(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100, 150)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def slice_from_the_end(spark, d):
    return frame.rows_between(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], -7)


@query()
def sample_exactly(spark, d):
    return frame.sample_rows(table(spark, d, "customer").select("c_custkey"), 100, 7, "c_custkey")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size").distinct()


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def extra_intersect(spark, d):
    return table(spark, d, "customer").select("c_nationkey").intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def extra_except(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::int AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def extra_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) <= 2")
def extra_top_k_per_group(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc())
    return table(spark, d, "orders").withColumn("r", F.rank().over(w)).where("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")
