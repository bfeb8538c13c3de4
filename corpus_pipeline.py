"""A training corpus from raw documents: reject, delete repeated lines, drop near copies, mix, encode.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before and returns a frame; ``run``
writes each result to the shared folder and reads it back for the next. Defined results for nulls, empty
texts, ties, repeated rows, empty tables and extra columns are those of the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetape.llm import byte_bpe, line_dedup, mixing, near_dedup, quality
from tonetape.llm.shared import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the limits of their language and source reject go."""
    return quality.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; n_chars follows the text."""
    return line_dedup.remove_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.repeat(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix."""
    return byte_bpe.digests(docs, public_tokenizers.path(byte_bpe.VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near dedup", near_copies),
    ("mixing", mixed_sources),
    ("byte-level BPE", token_ids),
]

#: SQL can't express alignment of lines nor near copies; the tests hold the operators of the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
