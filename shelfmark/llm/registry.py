"""Queries of the ten operators, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import chat, decontaminate, divergence, fingerprints, jaccard, language_model, packing, repair, secrets, substrings, tokens, toxicity, warc
from shelfmark.llm.common import scratch_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.digests(spark, path)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_decontamination, op3_ngram_jaccard, op4_toxicity, op5_substring_dedup, op6_packing, op7_fingerprints, op8_secrets, op9_warc, op10_token_counts, op11_conversation_repair, op12_source_divergence, op13_language_model)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.ORACLE_SQL, "op2_decontamination": decontaminate.ORACLE_SQL, "op3_ngram_jaccard": jaccard.ORACLE_SQL, "op5_substring_dedup": substrings.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op11_conversation_repair": repair.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
