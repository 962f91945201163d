"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from perfattr.llm import decontamination, line_dedup, near_duplicates, packing, quality
from perfattr.llm.common import stored, table

TOKENIZER = "word_bpe_49k.json"


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards those labelled good keeps."""
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one up to two edits; near copies keep those of their original."""
    return line_dedup.without_repeated_lines(docs, linked_copies=True)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.deduplicated(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, placed in sequences of 4096."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", remove_lines),
    ("MinHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("best-fit packing", pack),
]

#: Hashing, models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
