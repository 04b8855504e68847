"""Full-text search: an inverted index as a table, ranked by BM25 over weighted fields.

Postings carry term frequency and first position; document frequencies and lengths are tables of their own. A query
touches only the postings of its terms, and only the terms' counts are joined back.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import keep

#: Common words that carry no meaning (fixed values).
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "of", "on", "or", "our", "she", "so", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "to", "us", "was", "we", "were", "what", "when", "where", "which", "while", "who", "will", "with", "you", "your",
)


def folding() -> tuple[str, str]:
    """Letters whose canonical decomposition is one letter and combining marks, that letter for each, and then the marks, which go."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    bare = {ch: "".join(c for c in unicodedata.normalize("NFD", ch) if c not in marks) for ch in map(chr, range(0xC0, 0x2000))}
    found = [ch for ch, b in bare.items() if len(b) == 1 and b != ch and ch not in marks]
    return "".join([*found, *marks]), "".join(bare[ch] for ch in found)


ACCENTED, PLAIN = folding()
K1, B = 1.5, 0.75


#: ASCII that separates words.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "'")


def tokens(text: Column) -> Column:
    """Lower-case terms without accents: letters, digits and inner apostrophes, or runs beyond ASCII; two characters at least, no stopwords."""
    spaced = F.lower(F.translate(F.coalesce(text, F.lit("")), BETWEEN + ACCENTED, " " * len(BETWEEN) + PLAIN))
    apart = lambda s: F.regexp_replace(s, "([a-z0-9'](?=[^\\x00-\\x7f])|[^\\x00-\\x7f](?=[a-z0-9']))", "$1 ")
    # inside a lambda the spaced text is made once
    words = F.transform(F.array(spaced), lambda s: F.split(F.when(F.octet_length(s) == F.char_length(s), s).otherwise(apart(s)), " "))[0]
    bare = F.transform(words, lambda w: F.btrim(w, F.lit("'")))
    return F.filter(bare, lambda w: (F.char_length(w) >= 2) & ~w.isin(*STOPWORDS))


class Index:
    """Postings ``(term, doc, field, tf, first)``, lengths ``(doc, field, n)``, and boosts by field; an index just built has the documents' ``terms (doc, t)`` too."""

    def __init__(self, postings: DataFrame, lengths: DataFrame, boosts: dict[str, float], terms: DataFrame | None = None):
        self.postings, self.lengths, self.boosts, self.terms = postings, lengths, boosts, terms

    @classmethod
    def build(cls, docs: DataFrame, key: str, fields: dict[str, float]) -> Index:
        long = docs.select(F.col(key).alias("doc"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])).alias("x"))
        long = keep(long.select("doc", "x.field", "x.t"))  # texts are cut into terms once
        lengths = long.select("doc", "field", F.size("t").alias("n"))
        terms = long.select("doc", "field", F.posexplode("t").alias("at", "term"))
        postings = terms.groupBy("term", "doc", "field").agg(F.count(F.lit(1)).alias("tf"), F.min("at").alias("first"))
        return cls(postings, lengths, dict(fields), long.select("doc", "t"))

    def add(self, docs: DataFrame, key: str) -> Index:
        """A delta; documents that are there already are replaced."""
        new = Index.build(docs, key, self.boosts)
        kept = self.remove(docs.select(F.col(key).alias("doc")))
        return Index(kept.postings.unionByName(new.postings), kept.lengths.unionByName(new.lengths), self.boosts)

    def remove(self, ids: DataFrame) -> Index:
        return Index(self.postings.join(ids, "doc", "left_anti"), self.lengths.join(ids, "doc", "left_anti"), self.boosts)

    def merge(self, other: Index) -> Index:
        return Index(self.postings.unionByName(other.postings), self.lengths.unionByName(other.lengths), self.boosts)

    def vocabulary(self) -> DataFrame:
        if self.terms is None:
            return self.postings.groupBy("term").agg(F.count_distinct("doc").alias("df"))
        own = self.terms
        rows, docs = own.agg(F.count("doc"), F.count_distinct("doc")).first()
        if rows > docs:  # several fields, or a document twice
            own = own.groupBy("doc").agg(F.flatten(F.collect_list("t")).alias("t"))
        return own.select("doc", F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("doc").alias("df"))

    def expand(self, asked: DataFrame, prefix: bool = True, fuzzy: int = 0, synonyms: dict[str, Sequence[str]] | None = None) -> DataFrame:
        """``asked(q, term)`` with a weight, and what its terms stand for: synonyms (1) and, for terms that the index has not, terms that begin with
        them (0.8, from three letters on) and terms within ``fuzzy`` edits (0.5 at one, 0.2 at two; from five letters on one, from eight on two)."""
        known = keep(self.vocabulary().select(F.col("term").alias("t")))
        out = asked.withColumn("weight", F.lit(1.0))
        if synonyms:
            pairs = asked.sparkSession.createDataFrame([(a, b) for a, bs in synonyms.items() for b in bs], "term string, t string")
            out = out.unionByName(asked.join(F.broadcast(pairs), "term").join(known, "t").select("q", F.col("t").alias("term"), F.lit(1.0).alias("weight")))
        new = asked.select("term").distinct().join(known, F.col("term") == F.col("t"), "left_anti")
        near = None
        if prefix:
            head = lambda c: F.left(c, F.lit(3))
            near = new.where(F.char_length("term") >= 3).join(known, (head(F.col("term")) == head(F.col("t"))) & F.startswith("t", "term")).select("term", "t", F.lit(0.8).alias("weight"))
        if fuzzy:
            most = F.when(F.char_length("term") < 5, 0).when(F.char_length("term") < 8, min(fuzzy, 1)).otherwise(fuzzy)
            met = new.where(most > 0).select("term", F.explode(deletions(F.col("term"), fuzzy)).alias("d")).join(known.select("t", F.explode(deletions(F.col("t"), fuzzy)).alias("d")), "d").select("term", "t").distinct()
            close = met.withColumn("e", damerau(F.col("term"), F.col("t"), fuzzy)).where(F.col("e") <= most)
            close = close.select("term", "t", F.greatest(F.lit(0.0), 0.5 - 0.3 * (F.col("e") - 1)).alias("weight"))
            near = close if near is None else near.unionByName(close)
        if near is not None:
            out = out.unionByName(asked.join(near, "term").select("q", F.col("t").alias("term"), "weight"))
        return out.groupBy("q", "term").agg(F.sum("weight").alias("weight"))

    def search(self, queries: DataFrame, key: str, text: str, limit: int = 10, prefix: bool = False, fuzzy: int = 0, synonyms: dict[str, Sequence[str]] | None = None) -> DataFrame:
        """``key, doc, score, rank``: the best ``limit`` documents of each query, whose terms may be expanded."""
        asked = queries.select(F.col(key).alias("q"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
        asked = self.expand(asked, prefix, fuzzy, synonyms) if prefix or fuzzy or synonyms else asked.withColumn("weight", F.lit(1.0))
        stats = self.lengths.groupBy("field").agg(F.avg("n").alias("avg_n"))
        n_docs = self.lengths.agg(F.count_distinct("doc").alias("docs"))
        boost = F.create_map(*[F.lit(x) for f, b in self.boosts.items() for x in (f, float(b))])
        wanted = asked.select("term").distinct()
        hits = keep(self.postings.join(wanted, "term", "left_semi"))
        df = hits.groupBy("term").agg(F.count_distinct("doc").alias("df"))
        sized = hits.join(self.lengths, ["doc", "field"]).join(F.broadcast(stats), "field")
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avg_n")))
        per = sized.groupBy("term", "doc").agg(F.sum(boost[F.col("field")] * part).alias("w")).join(df, "term").crossJoin(F.broadcast(n_docs))
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        scores = asked.join(per.select("term", "doc", (idf * F.col("w")).alias("s")), "term").groupBy("q", "doc").agg(F.sum(F.col("weight") * F.col("s")).alias("score"))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "doc"))
        return scores.withColumn("rank", rank).where(F.col("rank") <= limit).withColumnRenamed("q", key)

    def suggest(self, words: DataFrame, column: str, most: int = 2) -> DataFrame:
        """The nearest term of the vocabulary for each word. Terms are met through their deletion neighbours, so no pair of unlike words is compared."""
        near = lambda df, c: df.select("*", F.explode(deletions(F.col(c), most)).alias("__d"))
        pairs = near(words.select(F.col(column).alias("word")).distinct(), "word").join(near(self.vocabulary(), "term"), "__d").select("word", "term", "df").distinct()
        close = pairs.withColumn("distance", F.levenshtein("word", "term")).where(F.col("distance") <= most)
        return close.groupBy("word").agg(F.min_by(F.struct("term", "distance"), F.struct("distance", -F.col("df"), "term")).alias("b")).select("word", "b.term", "b.distance")


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it without up to ``most`` letters."""
    out = F.array(word)
    for _ in range(most):
        shorter = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def scan(docs: DataFrame, fields: Sequence[str], text: str) -> DataFrame:
    """Without an index: documents that contain every word of a text in some field."""
    out = F.lit(True)
    for w in text.lower().split():
        found = F.lit(False)
        for f in fields:
            found |= F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(w))
        out &= found
    return docs.where(out)


def damerau(a: Column, b: Column, most: int = 2) -> Column:
    """Edit distance in which swapped neighbours count once, by row in numpy-free Python over Arrow batches; above ``most`` it is ``most`` + 1."""


    def distance(x, y):
        return pd.Series([edit_distance(p, q, most) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="Int32")

    return F.pandas_udf(distance, "int", F.PandasUDFType.SCALAR)(a, b)


def edit_distance(a: str, b: str, most: int) -> int:
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], older[j - 2] + 1)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)
