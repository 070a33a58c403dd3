"""The queries of the corpus operators, and SQL for those that SQL can express.

Each takes its whole table and gives a row per input row (op5: per query and rank, op6: per piece). Null texts
count as empty; null ids, repeated rows, empty tables and further columns do what the operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bitsliced, bpe, divergence, language, packing, phrases, quality_model, quality_rules, records, secrets, simhash, toxicity, warc
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", (language.fold(found.doc_id, 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_score, op3_warc_index, op4_bpe_automaton, op5_bitsliced_topk, op6_packing, op7_toxicity_crf, op8_language_kernel, op9_secret_scan, op10_simhash, op11_token_records, op12_phrases, op13_divergence)}
ORACLES = {"op3_warc_index": warc.ORACLE, "op5_bitsliced_topk": bitsliced.ORACLE, "op12_phrases": phrases.ORACLE, "op13_divergence": divergence.ORACLE}
