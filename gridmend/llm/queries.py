"""Queries of the corpus operators over the given tables, and their checking SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmend.llm import chat_format, decontaminate, filter_audit, line_dedup, minhash, mixing, pii, prefix_trie, quality_classifier, quality_rules, secret_scan, tokens, url_filter
from gridmend.session import prepare


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents"))


#: The rules of the URL query.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: A conversation of the query whose texts look like markers of a template.
HOSTILE_ID, HOSTILE = -7, r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(HOSTILE_ID, 0, "user", HOSTILE), (HOSTILE_ID, 1, "assistant", HOSTILE)], table.schema)
    return chat_format.read_back(chat_format.format_conversations(table.unionByName(more)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_minhash_dedup, op4_url_filter, op5_token_counts, op6_quality_classifier, op7_secret_scan, op8_pii, op9_decontaminate, op10_quality_rules, op11_filter_audit, op12_chat_format, op13_prefix_trie)}
ORACLES = {"op1_mix_sources": mixing.ORACLE, "op7_secret_scan": secret_scan.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_chat_format": chat_format.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
