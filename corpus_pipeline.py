"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, of documents'
columns in all but the last, whose rows are read back from the files it wrote.
A stage works on all that its predecessor kept. run() writes each stage's rows
to the folder in spark.checkpoint.dir before the next begins, so that a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import decontam, mixing, neardup, quality, tokenbin
from flowlens.llm.common import remove, shared_dir

TOKENIZER = "byte_bpe_50k.json"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep."""
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark items."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.apply_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document written, read back from the files."""
    return tokenbin.digest(tokenbin.encode_corpus(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality rules", good_documents),
    ("near duplicates", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("source mixing", mixed_documents),
    ("token ids", token_ids),
]

#: Signatures, EM and tokenizers are beyond SQL; a test holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Folders of earlier stages are removed once they are read; the last one is the caller's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
