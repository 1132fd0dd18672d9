"""The training-corpus pipeline over ``documents``.

Each stage calls one operator of ``stathouse.llm``, takes (spark, docs,
sf_dir) and works on all rows that the stage before it kept.  All but the
last return the columns of documents.

Nulls in lang, source and other columns pass through; a null or empty text,
or one without a letter, has no language and goes in the first stage.  Equal
rows are one document after the second.  A null doc_id counts as the largest.
Very long texts are worked on whole.  An empty table stays empty in every
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stathouse.llm import jaccard_join, language_id, mixing, packing, secret_scan
from stathouse.llm.common import materialize


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letter) go."""
    return language_id.accepted(docs, language_id.fit(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least doc_id stays."""
    return jaccard_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    import public_tokenizers

    return secret_scan.redact(docs, secret_scan.vocabularies(public_tokenizers.path))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn, some twice, until each source has its target."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of sequences; a document that was drawn twice is packed twice."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_each),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification and hashed draws are outside of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
