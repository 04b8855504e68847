"""The expression language, predicates and the row language."""

from pyspark.sql import functions as F

from ..plans import expressions as E
from ..plans import predicates, rowlang
from ..registry import query, table


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS revenue, round(avg(l_quantity), 4) AS quantity, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 GROUP BY 1")
def expression_filter_calc_group(spark, d):
    df = E.calc(E.where(table(spark, d, "lineitem"), "l_discount between 0.05 and 0.07 and l_quantity < 24"), {"revenue": "l_extendedprice * l_discount"})
    return df.groupBy("l_returnflag").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) SELECT c_custkey FROM t WHERE NOT coalesce(k > 5, false) AND (k IS DISTINCT FROM 4)")
def expression_not_is_complement(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return E.where(df, "not (K > 5) and k != 4").select("c_custkey")


@query("""SELECT p_partkey, floor(p_retailprice / 100 * 10 + 0.5) / 10 AS rounded, trunc(p_retailprice)::double AS whole, p_size - 7 * floor(p_size / 7.0) AS rest, floor(p_retailprice / 50) * 50 AS edge,
 least(greatest(p_size, 10), 30)::double AS clamped, round(ln(p_retailprice), 6) AS logged, upper(left(p_name, 3)) AS head, length(p_name)::double AS n, CASE WHEN p_size > 25 THEN 'big' ELSE p_brand END AS label FROM part""")
def expression_functions(spark, d):
    formulas = {
        "rounded": "round(p_retailprice / 100, 1)", "whole": "int(p_retailprice)", "rest": "mod(p_size, 7)", "edge": "bin(p_retailprice, 50)", "clamped": "clamp(p_size, 10, 30)",
        "logged": "log(p_retailprice)", "head": "upper(left(p_name, 3))", "n": "len(p_name)", "label": "if(p_size > 25, 'big', p_brand)",
    }
    out = E.calc(table(spark, d, "part"), formulas)
    return out.withColumn("logged", F.round("logged", 6)).select("p_partkey", *formulas)


@query("SELECT p_partkey FROM part WHERE (p_name LIKE '%a%' OR p_brand IN ('Brand#11', 'Brand#22')) AND regexp_matches(p_type, '^[A-Z]') AND NOT contains(p_name, 'z')")
def expression_text_tests(spark, d):
    return E.where(table(spark, d, "part"), "(p_name like '%a%' or p_brand in ('Brand#11', 'Brand#22')) and p_type matches '^[A-Z]' and p_name not contains 'z'").select("p_partkey")


@query("SELECT o_orderkey, 2.0::double * extract(year FROM o_orderdate) AS y, -4.0::double AS p FROM orders WHERE NOT (o_totalprice < 1000 OR o_totalprice > 200000)")
def expression_dates_and_powers(spark, d):
    df = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return E.calc(E.where(df, "not (o_totalprice < 1000 or o_totalprice > 200000)"), {"y": "2 * year(day)", "p": "-2^2"}).select("o_orderkey", "y", "p")


@query("SELECT o_custkey, count(*)::double AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def expression_repeats(spark, d):
    df = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_totalprice")).alias("r"))
    out = E.calc(df, {"n": "count(r)", "total": "sum(r.o_totalprice)", "mean": "mean(r.o_totalprice)", "low": "min(r.o_totalprice)", "high": "max(r.o_totalprice)"})
    return out.select("o_custkey", "n", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), "low", "high")


@query("SELECT event_id, try_cast(replace(replace(t, '.', ''), ',', '.') AS double) AS v FROM (SELECT event_id, replace(cast(round(value, 2) AS varchar), '.', ',') AS t FROM events)")
def expression_comma_decimals(spark, d):
    df = table(spark, d, "events").select("event_id", F.replace(F.round("value", 2).cast("string"), F.lit("."), F.lit(",")).alias("t"))
    return E.calc(df, {"v": "t + 0"}, decimal=",").select("event_id", "v")


@query("SELECT p_partkey FROM part WHERE nullif(p_size, 7) IS NULL OR p_retailprice > 1000")
def expression_constraint(spark, d):
    df = table(spark, d, "part").withColumn("s", F.nullif("p_size", F.lit(7)))
    return df.where(E.valid(df, "s", "p_retailprice > 1000")).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag IN ('A', 'R') AND NOT (l_tax = 0)")
def predicate_from_json(spark, d):
    spec = {"and": [{"op": ">=", "col": "l_quantity", "value": 10}, {"op": "<", "col": "l_quantity", "value": 20}, {"in": ["l_returnflag", ["A", "R"]]}, {"not": {"op": "==", "col": "l_tax", "value": 0}}]}
    df = table(spark, d, "lineitem")
    return df.where(predicates.to_column(df, spec)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 > 90 AND (l_returnflag = 'A' OR l_discount = 0.05)")
def predicate_from_text(spark, d):
    df = table(spark, d, "lineitem")
    return df.where(predicates.to_column(df, predicates.parse('l_quantity * 2 > 90 && (l_returnflag == "A" || l_discount == 0.05)'))).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an') AND p_size >= 10 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
def filter_line(spark, d):
    df = table(spark, d, "part")
    return df.where(predicates.line_filter("p_name ~ AN && p_size >= 10 && p_brand in Brand#11, Brand#12, Brand#13")).select("p_partkey")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / avg(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS q, CASE WHEN l_quantity >= 40 THEN 'high' WHEN l_quantity >= 20 THEN 'mid' ELSE 'low' END AS grade,
 (10 < l_quantity AND l_quantity < 30) AS inner_band, CASE WHEN l_tax > 0.05 THEN l_extendedprice * 2 ELSE l_extendedprice END AS price FROM lineitem QUALIFY NOT (l_discount = 0 AND count(*) OVER () > 0)""")
def rows_program(spark, d):
    t = rowlang.Transform("""
      let half = l_quantity
      q = half / mean(l_quantity) over l_returnflag
      grade = match l_quantity {>= 40: "high", >= 20: "mid", _: "low"}
      inner_band: bool = 10 < l_quantity < 30
      price = l_extendedprice
      if (l_tax > 0.05)
        price = price * 2
      end
      if (l_discount == 0)
        delete
      end
      saveonly(l_orderkey, l_linenumber, q, grade, inner_band, price)
    """)
    return t.run(table(spark, d, "lineitem")).withColumn("q", F.round("q", 6))


@query("""SELECT event_id, round(sum(value) FILTER (value > 10) OVER w, 4) * CASE WHEN value > 10 THEN 1 END AS running, CASE WHEN value > 10 THEN lag(value) OVER (PARTITION BY user_id, value > 10 ORDER BY ts, event_id) END AS before,
 round(stddev_pop(value) OVER (PARTITION BY user_id), 4) AS spread, first(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS opening, count(*) OVER () AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def rows_windows(spark, d):
    t = rowlang.Transform("""
      running = sum(value) over user_id order ts where value > 10
      before = prev(value) over user_id order ts where value > 10
      spread = std(value) over user_id
      opening = first(value) over user_id order ts
      n = count() over all
      keep(event_id, running, before, spread, opening, n)
    """)
    return t.run(table(spark, d, "events"), order=["event_id"]).withColumns({"running": F.round("running", 4), "spread": F.round("spread", 4)})


@query("SELECT c_custkey, n_name AS nation, n_regionkey AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def rows_lookup_equal(spark, d):
    t = rowlang.Transform("nation = lookup n.n_name where n.n_nationkey == c_nationkey\nregion = lookup n.n_regionkey where n.n_nationkey == c_nationkey\nsaveonly(c_custkey, nation, region)")
    return t.run(table(spark, d, "customer"), {"n": table(spark, d, "nation").where("n_nationkey < 20")}, ref_order={"n": "n_nationkey"})


@query("WITH r AS (SELECT k, k * 10 AS lo, k * 10 + CASE WHEN k = 2 THEN 5 ELSE 10 END AS hi FROM range(0, 5) t(k)) SELECT p_partkey, k AS band FROM part LEFT JOIN r ON p_size >= lo AND p_size < hi")
def rows_lookup_range(spark, d):
    bands = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + F.when(F.col("id") == 2, 5).otherwise(10)).alias("hi"), F.lit("x").alias("g"))
    t = rowlang.Transform('g = "x"\nsaveonly(p_partkey, p_size, g)')
    base = t.run(table(spark, d, "part"))
    return rowlang.Transform("band = lookup r.k where r.g == g and r.lo <= p_size < r.hi\nsaveonly(p_partkey, band)").run(base, {"r": bands}, ref_order={"r": "k"})


@query("SELECT c_custkey, coalesce(n, 0) AS n, round(total, 2) AS total, round(weighted, 4) AS weighted FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, sum(o_totalprice * o_orderkey) / sum(o_orderkey) AS weighted FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def rows_aggregating_join(spark, d):
    t = rowlang.Transform("""
      n = count() where o.o_custkey == c_custkey
      total = sum(o.o_totalprice) where o.o_custkey == c_custkey
      weighted = wmean(o.o_totalprice, o.o_orderkey) where o.o_custkey == c_custkey
      saveonly(c_custkey, n, total, weighted)
    """)
    return t.run(table(spark, d, "customer"), {"o": table(spark, d, "orders")}).withColumns({"total": F.round("total", 2), "weighted": F.round("weighted", 4)})


@query("""WITH a AS (SELECT p_partkey AS id, p_brand AS h, p_size AS f, p_size + 7 AS t FROM part), b AS (SELECT s_suppkey, 'Brand#' || (10 + s_suppkey % 30)::varchar AS h, s_nationkey AS f, s_nationkey + 4 AS t, s_acctbal AS v FROM supplier)
 SELECT id, count(v) AS n, round(sum(v * greatest(0, least(a.t, b.t) - greatest(a.f, b.f))) / sum(greatest(0, least(a.t, b.t) - greatest(a.f, b.f))), 4) AS grade FROM a LEFT JOIN b ON a.h = b.h AND b.f < a.t AND b.t > a.f GROUP BY id""")
def rows_overlap_join(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("h"), F.col("p_size").alias("f"), (F.col("p_size") + 7).alias("t"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), (10 + F.col("s_suppkey") % 30).cast("string")).alias("h"), F.col("s_nationkey").alias("f"), (F.col("s_nationkey") + 4).alias("t"), F.col("s_acctbal").alias("v"))
    t = rowlang.Transform("n = count() where b.h == h and overlap(b.f, b.t, f, t)\ngrade = wmean(b.v, overlap) where b.h == h and overlap(b.f, b.t, f, t)\nsaveonly(id, n, grade)")
    return t.run(a, {"b": b}).withColumn("grade", F.round("grade", 4))


@query("SELECT 'quantity' AS name, sum((l_quantity > 0)::int)::bigint AS passed, sum((NOT l_quantity > 0)::int)::bigint AS failed FROM lineitem UNION ALL SELECT 'discount', sum((l_discount < 0.09)::int)::bigint, sum((NOT l_discount < 0.09)::int)::bigint FROM lineitem")
def rows_checks(spark, d):
    return rowlang.Transform('check "quantity": l_quantity > 0\ncheck "discount": l_discount < 0.09').checks(table(spark, d, "lineitem"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey <= (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 250000)")
def rows_exit(spark, d):
    return rowlang.Transform("if (o_totalprice > 250000)\n exit\nend\nsaveonly(o_orderkey)").run(table(spark, d, "orders"), order=["o_orderkey"])
