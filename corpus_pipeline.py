"""From raw documents to token ids: quality, near-duplicates, personal data, the mix of sources, encoding.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns of
``documents``: rejected documents and all but one of each group of near-duplicates are gone, personal data are
placeholders, and documents stand in training order, as often as the mix reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, pieces, pii, quality, simhash
from tessera.llm.common import keep
from tessera.llm.queries import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    return pieces.encoded(docs, model or public_tokenizers.path("piece_bpe_32k.model"), lists=("ids",))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The compression ratios, XXH64 and the tokenizer have no SQL; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
