"""A pipeline over the corpus operators: quality rules, language, near-duplicates, secrets, packing.

All stages but the last keep the columns of documents, whatever others there are. Rows with a null, empty or
blank text go in the first stage; a null id takes no part in near-duplicates and stays; repeated rows are kept or
dropped together, but copies under other ids are near-duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelens.llm import language, packing, quality_rules, secrets, simhash
from tidelens.llm.common import shared_dir, table


#: One-versus-rest scores sum to about 1, so of four languages the best has 0.25 or more whatever the text. Sentences of eleven
#: other languages scored up to 0.46, the lowest of 9,152 documents of sf0.1 0.53.
MIN_SCORE = 0.5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.quality_filter(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go."""
    return language.language_filter(docs, language.fit(docs), min_score=MIN_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id."""
    return simhash.first_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them become a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents become pieces of training sequences, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [("quality_rules", rules), ("language_id", languages), ("simhash", near_duplicates), ("secrets", redact_secrets), ("packing", pack)]
#: SQL has no compressors, kernels or tokenizers: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
