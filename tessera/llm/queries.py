"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, mixing, oracles, pictures, pieces, pii, quality, sharding, simhash, suffixes, templates
from .common import keep

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # texts reach Python a thousand rows at a time, so that a batch of long ones stays small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the base rule and the verdict of the compression bands for every document."""
    return quality.quality(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "`__quality`.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """Bytes of every document that lie in a 200-byte string found elsewhere too; the table's files come in as batches, or rows of it by a hash of their id if there are too few files."""
    docs = table(spark, sf_dir, "documents")
    files = sorted(docs.inputFiles())
    if len(files) >= batches:
        parts = [spark.read.schema(docs.schema).parquet(*files[k::batches]) for k in range(batches)]
    else:
        parts = [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k) for k in range(batches)]
    family = suffixes.family_of(parts)
    return suffixes.cut(docs, suffixes.compare(docs, family), texts=False)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return templates.extract(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, equal texts kept together and bytes as even as groups allow."""
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document, and the place in training of its first reading."""
    docs = table(spark, sf_dir, "documents")
    sized = keep(docs.select("doc_id", "source", mixing.word_count("text").alias("size")), "sizes")
    planned = mixing.plan(sized, size=F.col("size"))
    return planned.orderBy(F.get("__mix_positions", F.lit(0)).asc_nulls_last(), "__mix_order").select(
        "doc_id", "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_taken").alias("taken"), F.get("__mix_positions", F.lit(0)).alias("first_position")
    )


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited crops of the pictures whose id 20 divides, searched for among all pictures."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = pictures.pictures_of(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", edit=True)
    found = pictures.search(asked, pictures.pictures_of(vectors, "vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str, order: int = 3) -> DataFrame:
    """Scores of all documents under a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()), order=order)
    out = kneser_ney.scored(docs, model)
    return out.select("doc_id", kneser_ney.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Ids, decoded text and byte spans of every document, as digests."""
    import public_tokenizers

    return pieces.encoded(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"), lists=())


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document: the fixed patterns and what the field adds."""
    return pii.found(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_media_columns, op2_lm_scoring, op3_sentencepiece, op4_pii, op5_suffix_dedup, op6_html_extraction, op7_sharding, op8_simhash_near_dedup, op9_quality_rules, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
