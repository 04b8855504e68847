"""Scalar functions: spreadsheet text and dates, units, rounding, shell-like text tools."""

from pyspark.sql import functions as F

from ..functions import blanks as B
from ..registry import query, table


@query("SELECT o_orderkey, (o_orderdate::date - date '1899-12-31')::int + 1 AS serial, o_orderdate::date AS day FROM orders")
def spreadsheet_dates(spark, d):
    df = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    df = df.withColumn("serial", B.date_serial(F.col("day")))
    return df.select("o_orderkey", "serial", B.date_from_serial(F.col("serial")).alias("day"))


@query("SELECT p_partkey, floor(-p_retailprice * 10 + 0.5) / 10 AS half_up, trunc(-p_retailprice)::double AS whole, -p_size - 3 * floor(-p_size / 3.0) AS rest, floor((p_size - 1) / 4.0) * 4 + 1 AS edge FROM part")
def rounding_family(spark, d):
    n = -F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", B.round_half_up(n, 1).alias("half_up"), B.truncate(n).alias("whole"), B.floored_mod(-F.col("p_size").cast("double"), F.lit(3.0)).alias("rest"), B.lower_edge(F.col("p_size").cast("double"), F.lit(4.0), F.lit(1.0)).alias("edge"))


@query("SELECT p_partkey, round(p_size * 0.3048::double, 6) AS metres, round(p_size * 31.1034768::double, 4) AS grams_per_tonne, round(least(greatest(p_retailprice, 1000), 1500), 2) AS clamped, round((p_size - 1) * 100.0 / 49, 6) AS percent FROM part")
def units_clamp_remap(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(B.convert(s, "ft", "m"), 6).alias("metres"), F.round(B.convert(s, "oz/t", "g/t"), 4).alias("grams_per_tonne"), F.round(B.clamp(F.col("p_retailprice"), 1000, 1500), 2).alias("clamped"), F.round(B.remap(s, 1, 50, 0, 100), 6).alias("percent"))


@query("SELECT p_partkey, left(p_name, 4) AS head, right(p_name, 4) AS foot, substring(p_name, 2, 3) AS middle, length(p_name) AS n, nullif(p_brand, 'Brand#11') AS brand, p_name || coalesce(nullif(p_brand, 'Brand#11'), '') AS joined FROM part")
def text_functions(spark, d):
    b = F.nullif("p_brand", F.lit("Brand#11"))
    return table(spark, d, "part").select("p_partkey", F.left("p_name", F.lit(4)).alias("head"), F.right("p_name", F.lit(4)).alias("foot"), F.substring("p_name", 2, 3).alias("middle"), F.char_length("p_name").alias("n"), b.alias("brand"), B.text_join(F.col("p_name"), b).alias("joined"))


@query("SELECT event_id, json_extract_string(props, '$.k')::bigint AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS words, strlen(text) AS bytes FROM documents")
def count_lines_words_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[Ll]icense')")
def grep_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("[Ll]icense"))


@query("SELECT p_partkey, string_split(p_type, ' ')[2] AS field, substring(p_type, 1, 3) AS head, translate(p_brand, 'Bd#', 'bD-') AS translated FROM part")
def cut_and_translate(spark, d):
    return table(spark, d, "part").select("p_partkey", F.get(F.split("p_type", " "), F.lit(1)).alias("field"), F.substring("p_type", 1, 3).alias("head"), F.translate("p_brand", "Bd#", "bD-").alias("translated"))


@query("SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_tax, 0) AS ratio, coalesce(nullif(l_tax, 0), -1) AS tax FROM lineitem")
def total_division(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.try_divide("l_quantity", "l_tax").alias("ratio"), F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(-1.0)).alias("tax"))


@query("SELECT avg(coalesce(nullif(p_size, 7), 0)) AS mean_with_blanks, sum(p_size)::bigint - sum(CASE WHEN p_size = 7 THEN 7 ELSE 0 END)::bigint AS total FROM part")
def spreadsheet_aggregates(spark, d):
    c = F.coalesce(F.nullif("p_size", F.lit(7)), F.lit(0))
    return table(spark, d, "part").agg(F.avg(c).alias("mean_with_blanks"), F.sum(c).alias("total"))


@query("SELECT (i * 0.25)::double AS x FROM range(0, 41) t(i)")
def linspace(spark, d):
    return spark.range(41).select((F.col("id") * F.lit(0.25)).alias("x"))
