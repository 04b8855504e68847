"""Round trips through formats, and readers with their own rules. Files go to the shared folder."""

import uuid

from pyspark.sql import functions as F

from ..plans.shared import folder
from ..registry import query, table
from ..sources import binary, text


def place(spark, kind):
    return f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query("SELECT c_custkey::double AS c_custkey, c_name, c_nationkey::double AS c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def source_csv(spark, d):
    path = place(spark, "csv")
    text.write_csv(table(spark, d, "customer"), path)
    return text.read_csv(spark, path).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT n_nationkey::double AS n_nationkey, 'a;\"' || n_name AS n_name, n_regionkey + 0.5::double AS half FROM nation")
def source_csv_comma_decimals(spark, d):
    path = place(spark, "csv")
    df = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit('a;"'), "n_name").alias("n_name"), F.concat(F.col("n_regionkey").cast("string"), F.lit(",5")).alias("half"))
    text.write_csv(df, path, ";")
    return text.read_csv(spark, path)


@query("SELECT s_suppkey::double AS s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def source_csv_gzip(spark, d):
    path = place(spark, "csv-gz")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.csv(path, header=True, compression="gzip")
    return text.read_csv(spark, path).withColumn("s_acctbal", F.round("s_acctbal", 2))


@query("SELECT n_nationkey::double AS n_nationkey, n_name || chr(10) || 'x, \"y\"' AS note FROM nation")
def source_csv_line_breaks(spark, d):
    path = place(spark, "csv")
    text.write_csv(table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit('\nx, "y"')).alias("note")).coalesce(1), path)
    return text.read_csv(spark, path)


@query("SELECT p_size::double AS size, p_retailprice AS price FROM part")
def source_geoeas(spark, d):
    path = place(spark, "geoeas")
    body = table(spark, d, "part").select(F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("value"))
    head = spark.createDataFrame([("parts\n2\nsize\nprice",)], "value string")
    head.coalesce(1).unionByName(body).coalesce(1).write.text(path)
    return text.read_geoeas(spark, path)


@query("SELECT r_regionkey, r_name FROM region")
def source_json(spark, d):
    path = place(spark, "json")
    table(spark, d, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value")).write.text(path)
    return text.read_json(spark, path, "r_regionkey int, r_name string")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def source_orc_pruned(spark, d):
    path = place(spark, "orc")
    table(spark, d, "supplier").write.partitionBy("s_nationkey").orc(path)
    return spark.read.orc(path).where("s_nationkey = 3").select("s_suppkey", "s_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def source_parquet_pushdown(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@query("SELECT 'n_name' AS column, 25::bigint AS rows, 0::bigint AS nulls, min(n_name) AS low, max(n_name) AS high FROM nation")
def source_parquet_footer(spark, d):
    return binary.parquet_statistics(spark, f"{d}/nation.parquet").where("column = 'n_name'").select("column", "rows", "nulls", "low", "high")


@query("SELECT n_nationkey::double AS n_nationkey, n_name, n_regionkey = 1 AS first FROM nation")
def source_workbook(spark, d):
    rows = [["n_nationkey", "n_name", "first"]] + [[r["n_nationkey"], r["n_name"], r["n_regionkey"] == 1] for r in table(spark, d, "nation").collect()]
    return spark.createDataFrame([(bytearray(binary.write_sheet(rows)),)], "content binary").mapInPandas(_sheets, "n_nationkey double, n_name string, first boolean")


def _sheets(frames):
    import pandas as pd

    for f in frames:
        for raw in f["content"]:
            top, *rows = binary.sheet_rows(raw)
            yield pd.DataFrame(rows, columns=top)


@query("SELECT round(s_suppkey * 1.5::double, 3) AS x, round(s_acctbal, 3) AS z, (s_nationkey * 10)::int AS intensity FROM supplier")
def source_point_cloud(spark, d):
    import numpy as np

    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey").toPandas()
    raw = binary.las_file(rows["s_suppkey"].to_numpy() * 1.5, np.zeros(len(rows)), rows["s_acctbal"].to_numpy(), rows["s_nationkey"].to_numpy() * 10)
    points = lambda frames: (binary.las_points(r, ["x", "z", "intensity"]) for f in frames for r in f["content"])
    return spark.createDataFrame([(bytearray(raw),)], "content binary").mapInPandas(points, "x double, z double, intensity int").withColumns({"x": F.round("x", 3), "z": F.round("z", 3)})


@query("SELECT trim(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line LIKE 'T%' GROUP BY 1")
def source_lines(spark, d):
    path = place(spark, "lines")
    table(spark, d, "documents").select(F.concat(F.lit("# a comment\n"), F.regexp_replace("text", "\r", "")).alias("value")).write.text(path)
    out = text.lines(spark, path, "#").where(F.startswith("line", F.lit("T")))
    return out.groupBy(F.trim("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey::double AS KEY, p_brand AS BRAND, CASE WHEN p_size = 7 THEN NULL ELSE p_size::double END AS SIZE FROM part")
def source_paged_binary(spark, d):
    from ..sources import paged

    p = table(spark, d, "part").orderBy("p_partkey").toPandas()
    raw = paged.encode({"KEY": p["p_partkey"].tolist(), "BRAND": p["p_brand"].tolist(), "OTHER": p["p_retailprice"].tolist(), "SIZE": [None if s == 7 else s for s in p["p_size"].tolist()]})
    decode = lambda frames: (paged.decode(r, ["KEY", "BRAND", "SIZE"]) for f in frames for r in f["content"])
    out = spark.createDataFrame([(bytearray(raw),)], "content binary").mapInPandas(decode, "KEY double, BRAND string, SIZE double")
    return out.withColumn("SIZE", F.when(~F.isnan("SIZE"), F.col("SIZE")))
