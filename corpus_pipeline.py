"""A training corpus from raw documents: language, quality, near-duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyweave.llm import bpe, langid, minhash, mixing, quality
from keyweave.llm.queries import tokenizer
from keyweave.llm.stage import drop_staged, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified_documents(docs, langid.train(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, *tokenizer())


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: A trained model decides the first stage, and alignments the third: no SQL has these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result; what a stage staged on its way, and what it was given, is gone once it is written."""
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = written(lambda: stage(spark, docs, sf_dir), "stage")
        if docs is not given:
            drop_staged(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
