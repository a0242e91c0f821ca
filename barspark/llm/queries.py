"""The queries of this package: thin contracts over the operators, each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barspark.llm import oracles, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.quality import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_ngram_jaccard", oracles.jaccard(4, 85))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.jaccard import ngram_jaccard
    return ngram_jaccard(table(spark, sf_dir, "documents"), n=4, percent=85)


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.decontaminate import leaks
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules of the query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op4_url_filter", urls.oracle([urls.Rule(*r) for r in URL_RULES]))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), [urls.Rule(*r) for r in URL_RULES])


@query("op5_near_vectors", oracles.near_vectors(0.98))
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.vectors import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_token_ids")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.tokens import new_shards, tokenizer_path
    read = new_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_substring_dedup", oracles.repeats(13))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.substrings import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"), size=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.secrets import secret_report
    return secret_report(table(spark, sf_dir, "documents"))


@query("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.mixing import mix_report
    return mix_report(table(spark, sf_dir, "documents"))


#: The key of the query's replacements; a production job passes its own.
SURROGATE_KEY = "corpus"


@query("op10_pii_surrogates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.pii import surrogate_report
    return surrogate_report(table(spark, sf_dir, "documents"), SURROGATE_KEY)


@query("op12_merkle_manifest", oracles.manifest())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.manifest import manifest_report
    return manifest_report(table(spark, sf_dir, "documents"))


@query("op11_vector_codes", oracles.vector_codes())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.lloyd import codes_report
    return codes_report(table(spark, sf_dir, "embeddings"))


@query("op13_quality_rules")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barspark.llm.rules import rules_report
    return rules_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
