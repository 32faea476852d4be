"""A pipeline of training-data stages over documents, each written and read again before the next.

Rows that the quality rules reject go; one document of each near-duplicate group stays; personal data is replaced by
its kind; documents are repeated or left out as the mix of sources asks; what remains is encoded and decoded again.
Null and empty texts are rejected by the first stage. Repeated rows are near duplicates: one stays, that of the smallest
doc_id, and where ids are equal or null one of each text's group. Texts are taken whole by every stage, however long, and
extra columns, whatever their names, go along up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import byte_bpe, mixing, pii, quality_rules, simhash
from weftline.llm.common import materialize

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words_each=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number of tokens, and digests of the ids, of the text that they decode to and of their offsets."""
    return byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN, keep=("source",))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]
#: Vote EM, SimHash and the tokenizer are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
