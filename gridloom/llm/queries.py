"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import conversation_repair, decontaminate, hard_negatives, line_clean, media, ngram_join, quality, secrets, token_store, tool_calls, toxicity, tree_bpe, url_rules
from gridloom.llm.common import scratch, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=2)
    return token_store.read_digests(spark, path)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = secrets.train(secrets.labelled_samples(docs))
    return secrets.digest(secrets.scan(docs, ratios))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_from_conversations(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, "name string, arg string, type string, required boolean")
    return tool_calls.report(calls, results, schemas)


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.digest(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.digest(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_table(spark))
    return url_rules.digest(judged)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    media.write(table(spark, sf_dir, "documents"), path)
    return media.digest(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


def op12_line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_clean.digest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_ngram_join": op2_ngram_join,
    "op3_decontaminate": op3_decontaminate,
    "op4_secrets": op4_secrets,
    "op5_tool_calls": op5_tool_calls,
    "op6_tree_bpe": op6_tree_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_media": op10_media,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_line_clean": op12_line_clean,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_tool_calls": tool_calls.ORACLE,
    "op9_urls": url_rules.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_line_clean": line_clean.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
