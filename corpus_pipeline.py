"""A corpus pipeline of five stages, from raw documents to token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's result as Parquet in the shared folder and reads it back for the
next, then deletes what went before.  All but the last stage return the columns
of documents, with extra ones untouched.

Rows with nulls: a null text has no language and goes; a null doc_id is kept as
its own document; a null source or lang is a value like any other.  Repeated
rows are near copies and one stays.  Of texts without words only the language
stage decides.  An empty table, or an empty stage, leaves none for those after.
Long texts are read whole by each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import contamination, language, mixing, simhash, tokens
from pagemill.llm.common import discard, materialise, scratch, table

#: No SQL expresses the hash, the classifier or the tokenizer.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return contamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents until sources have their target weights."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left into shards and read the shards back."""
    import public_tokenizers

    return tokens.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            after = materialise(stage(spark, docs, sf_dir), f"stage-{i}")
            keep(after)
        discard(docs)
        docs = after
    # The shards that the last stage writes stay beside its table.
    return materialise(STAGES[-1][1](spark, docs, sf_dir), f"stage-{len(STAGES) - 1}")
