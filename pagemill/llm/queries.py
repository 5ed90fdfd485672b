"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import chat, contamination, fingerprints, language, lines, mixing, simhash, tokens, toxicity, urls
from pagemill.llm.common import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(chat.PLANTED, rows.schema)
    return chat.digests(materialise(chat.format_conversations(rows.unionByName(planted)), "chat"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"))


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def _contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": _simhash,
        "op2_tokens": _tokens,
        "op3_language": _language,
        "op4_lines": _lines,
        "op5_chat": _chat,
        "op6_urls": _urls,
        "op7_mixing": _mixing,
        "op8_fingerprints": _fingerprints,
        "op9_toxicity": _toxicity,
        "op10_contamination": _contamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_lines": lines.ORACLE, "op10_contamination": contamination.ORACLE, "op5_chat": chat.ORACLE, "op6_urls": urls.ORACLE, "op7_mixing": mixing.ORACLE}
