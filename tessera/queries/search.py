"""Text search over documents and benchmark passages."""

from pyspark.sql import functions as F

from ..operators import search as S
from ..registry import query, table

STOP = ", ".join(f"'{w}'" for w in "a an and are as at be but by for from has have he her his i if in into is it its of on or our she so than that the their them then there these they this to us was we were what when where which while who will with you your".split())
TOKENS = f"list_filter(list_transform(regexp_extract_all(lower(strip_accents(coalesce({{}}, ''))), '([a-z0-9'']+|[^\\x00-\\x7f]+)', 1), lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: length(w) >= 2 AND w NOT IN ({STOP}))"


@query(f"SELECT term, count(DISTINCT doc) AS df FROM (SELECT doc_id AS doc, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY 1")
def search_vocabulary(spark, d):
    return S.Index.build(table(spark, d, "documents"), "doc_id", {"text": 1.0}).vocabulary()


@query(f"""WITH t AS (SELECT doc_id AS doc, {TOKENS.format('text')} AS t FROM documents), l AS (SELECT doc, len(t) AS n FROM t), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM t) GROUP BY 1, 2),
 a AS (SELECT item_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM benchmark), g AS (SELECT avg(n) AS avg_n, count(*) AS docs FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 s AS (SELECT item_id, p.doc, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_n))) AS score FROM a JOIN p USING (term) JOIN f USING (term) JOIN l ON l.doc = p.doc, g GROUP BY 1, 2)
 SELECT item_id, doc, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc) <= 1""")
def search_ranked(spark, d):
    found = S.Index.build(table(spark, d, "documents"), "doc_id", {"text": 1.0}).search(table(spark, d, "benchmark"), "item_id", "text", 1)
    return found.select("item_id", "doc", F.round("score", 4).alias("score"))


@query(f"""WITH t AS (SELECT doc_id AS doc, {TOKENS.format('text')} AS t FROM documents), l AS (SELECT doc, len(t) AS n FROM t), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM t) GROUP BY 1, 2),
 g AS (SELECT avg(n) AS avg_n, count(*) AS docs FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), a AS (SELECT DISTINCT item_id, left(w, 6) AS term FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS w FROM benchmark) WHERE length(w) > 6),
 e AS (SELECT item_id, term, 1.0 AS weight FROM a UNION ALL SELECT item_id, f.term, 0.8 FROM a JOIN f ON starts_with(f.term, a.term) WHERE a.term NOT IN (SELECT term FROM f)),
 s AS (SELECT item_id, p.doc, sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_n))) AS score FROM e JOIN p USING (term) JOIN f USING (term) JOIN l ON l.doc = p.doc, g GROUP BY 1, 2)
 SELECT item_id, doc, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc) <= 1""")
def search_expanded(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", F.transform(F.filter(S.tokens(F.col("text")), lambda w: F.char_length(w) > 6), lambda w: F.left(w, F.lit(6)))).alias("text"))
    found = S.Index.build(table(spark, d, "documents"), "doc_id", {"text": 1.0}).search(words, "item_id", "text", 1, prefix=True)
    return found.select("item_id", "doc", F.round("score", 4).alias("score"))


@query(f"SELECT term, count(DISTINCT doc) AS df FROM (SELECT doc_id AS doc, unnest({TOKENS.format('text')}) AS term FROM documents WHERE doc_id % 3 <> 0) GROUP BY 1")
def search_incremental(spark, d):
    docs = table(spark, d, "documents")
    index = S.Index.build(docs.where("doc_id % 2 = 0"), "doc_id", {"text": 1.0}).add(docs.where("doc_id % 2 = 1"), "doc_id")
    return index.remove(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("doc"))).vocabulary()


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'the')")
def search_scan(spark, d):
    return S.scan(table(spark, d, "documents"), ["text"], "License the").select("doc_id")


@query()
def search_suggestions(spark, d):
    index = S.Index.build(table(spark, d, "part"), "p_partkey", {"p_name": 2.0, "p_type": 1.0})
    words = table(spark, d, "part").select(F.explode(S.tokens(F.col("p_name"))).alias("w")).distinct().select(F.concat(F.substr("w", F.lit(2), F.char_length("w")), F.lit("x")).alias("w"))
    return index.suggest(words, "w")


@query()
def search_edit_distance(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_name", S.damerau(F.col("n_name"), F.concat(F.substr("n_name", F.lit(2), F.lit(1)), F.left("n_name", F.lit(1)), F.substr("n_name", F.lit(3))), 2).alias("distance"))
