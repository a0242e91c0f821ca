"""Training-corpus pipeline: documents to token shards, a stage for each operator it uses.

quality          documents that the classifier rejects go
near_duplicates  of each component of five-word shingle sets at 0.8 the smallest id stays
decontaminate    documents that cover a benchmark item go
mix              all documents, put in the order that interleaves sources by their weights
tokens           token shards in that order; returns what a reader finds in them
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from barspark.llm import decontaminate as leaks, jaccard, mixing, quality, tokens
from barspark.llm.frames import partitions, stored

TOKENIZER = "byte_bpe_50k.json"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, partitions(spark))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards in the stored order of ``docs`` (by id, if it does not come from files). Rows without an id
    cannot be referred to and are left out here."""
    order = tokens.stored_order(docs)
    try:
        docs.select(*order)
    except AnalysisException:
        order = None
    read = tokens.new_shards(docs, tokens.tokenizer_path(TOKENIZER), end_id=0, order=order)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: (name, function of (spark, docs, sf_dir)) in order; each function's rows are written and read again.
STAGES = [("quality", good), ("near_duplicates", distinct), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", tokenized)]

#: The classifier, the tokenizer and the schedule have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
