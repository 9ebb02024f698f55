"""A training corpus from documents: quality, language, near duplicates, benchmark, tokens.

Each stage takes what the stage before it kept. The first four return whole documents, the last
one the digests of the token ids and of the text that they decode to.

No stage fails on odd rows. Null, empty and blank texts have too few words and go in the first
stage, as do texts of one repeated phrase; a null id or language never decides by itself; texts of
any length are read whole; equal rows are judged alike until the near-duplicate stage leaves one
of them; an empty table gives an empty one, and further columns are carried along under their
names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillweave.llm import decontaminate, language, near_dup, quality_rules, queries
from fillweave.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or diverge from every language's histograms, go."""
    return quality_rules.passing_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that has at least half of them, go."""
    return language.identified_documents(docs, language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that of the smallest id, or without ids of the smallest text hash."""
    return near_dup.distinct_documents(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of the text decoded from them."""
    return queries.codec_digests(docs, queries.tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs


#: SQL can't express language identification or tokens: tests hold each stage against brute force.
ORACLE_SQL = None
