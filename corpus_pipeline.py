"""A training corpus from the documents table, in five stages; each is written as Parquet and read again by the next.

1. language: documents whose language can't be told go;
2. near copies: one document of each group of near copies stays;
3. personal data: what is found is replaced by marks in the text;
4. mixing: documents are taken as often as the target weights of their sources ask;
5. tokens: texts are encoded, and decoded again.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, language, mixing, pii, simhash
from tidewatch.llm.common import shared_folder, table
from tidewatch.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids and decoded of each row."""
    return bpe.encode(docs, vocabulary_path(), ("source", "lang"))


STAGES: list[tuple[str, Stage]] = [("language", identify), ("near_copies", deduplicate), ("personal_data", redact), ("mixing", mix), ("tokens", tokenize)]

#: SimHash components and the tilted rates can't be said in SQL: tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each from the table that the one before wrote to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = posixpath.join(shared_folder(spark), f"corpus-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
