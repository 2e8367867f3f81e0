"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

language    documents whose language is undecided (no text, no letter, or a score below the least) go
near_dedup  of each component of near-duplicate documents the one with the smallest id stays
decontaminate  documents go of whose words a twentieth or more lie in passages of the benchmark
secrets     every secret span is replaced by its kind; all documents stay
bpe         token ids of what is left, with digests of the ids and of the bytes they decode to

Defined results.  Null and empty texts go in the first stage; later stages take them as texts without words.  Rows without an id
are documents like any other: they stay unless they are near copies of a row with an id, or of another without one.  Of rows with
one id, near copies of each other, the one with the smallest hash of all its columns stays; others are documents of their own.  Ties between
languages go to the first in sorted order.  Texts of any length are read whole by every stage.  Empty tables give empty tables.
All stages but the last return the columns of documents, whatever they are named and however many more there are; they read doc_id,
text and, to learn, lang, and secrets also sets n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import bpe, common, decontaminate, language, secrets, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.train(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, common.read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.vocabulary(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_languages),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", tokens),
]
#: The network, the fingerprints and the merges have no SQL form; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
