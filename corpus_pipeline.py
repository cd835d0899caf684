"""The corpus pipeline: stages that hand on documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from llm.bpe import encode_documents, read_ranks
from llm.common import store
from llm.edits import without_items
from llm.exact import exact_dedup
from llm.jaccard import first_of_similar
from llm.language import identify

RANKS = "byte_bpe_multi_50k.tiktoken"


def beside(docs: DataFrame, step: Callable[[DataFrame], DataFrame], keep: str, added: tuple[str, ...]) -> DataFrame:
    """The rows of `docs` that `keep` chooses after a step that adds columns, with their own columns.

    Columns of `docs` with the name of an added one, or a dot in their name, which Arrow maps can't
    address, stand aside during the step and keep their values.
    """
    aside = {}
    for name in (c for c in docs.columns if c in added or "." in c):
        other = f"{name}_given".replace(".", "_")
        while other in docs.columns or other in aside.values():
            other += "_"
        aside[name] = other
    found = step(docs.withColumnsRenamed(aside) if aside else docs).filter(keep)
    return found.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; all columns as they were.

    Null and empty texts and texts without a letter go. Each row is judged by its text alone, so
    repeated rows and rows of equal or null doc_id stay or go together.
    """
    return beside(docs, identify, "not rejected", ("lang_pred", "score", "rejected"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id stays; all columns as they were.

    Null and empty texts are one group. Null ids come last; of equal ids, as in repeated rows, the
    first by file and place stays.
    """
    return beside(docs, lambda rows: exact_dedup(spark, rows), "kept", ("keep_id", "group_size", "kept", "text_sha256"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a similarity of 0.8 or more over five-word shingles the one with the
    smallest doc_id stays; all columns as they were.

    Null ids come last, of equal ids the first row stays. Texts without words, null ones too, are
    one group.
    """
    return first_of_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark occurs within its edit budget; all columns as they were.

    Null and empty texts and items match nothing; each row is judged by its text alone.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return beside(docs, lambda rows: without_items(rows, items), "true", ())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document; null and empty texts have no tokens, repeated rows a row each."""
    ranks = read_ranks(spark, public_tokenizers.path(RANKS))
    return encode_documents(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("exact_copies", drop_copies),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("tokens", encode),
]

#: No SQL form: trained scores, fingerprints and merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for step, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if step < len(STAGES) - 1:
            docs = store(docs, name)
    return docs
