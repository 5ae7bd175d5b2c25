"""The corpus pipeline: STAGES are applied to `documents` one after another, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from quillspark.llm._common import Written, table
from quillspark.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go."""
    return language_id.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents that lose all they say."""
    return line_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share four fifths of their five-word shingles the one of least id stays."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes pieces of training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", identify_language), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: Language identification and packing compress and tokenize, which SQL cannot; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; each one's result is written to the shared folder and read again."""
    docs, write = table(spark, sf_dir, "documents"), Written(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write(docs)
            if k:
                write.drop(before)
    return docs
