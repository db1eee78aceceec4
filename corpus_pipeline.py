"""The corpus pipeline: documents through the stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparksync.llm.decontaminate import decontaminate
from sparksync.llm.near_dups import one_of_each
from sparksync.llm.pieces import encode, read_pieces
from sparksync.llm.queries import piece_model, table
from sparksync.llm.suffix_dedup import remove_repeats
from sparksync.llm.toxicity import fit_toxicity
from sparksync.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go, each by its own text, also where ids are repeated or null."""
    return fit_toxicity(docs, table(spark, sf_dir, "labels")).accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest doc_id; see ``one_of_each``."""
    return one_of_each(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte under a string of 100 bytes that also starts earlier goes."""
    return remove_repeats(docs, width=100)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of contaminated documents; those that are half passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), width=13)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    return encode(docs, read_pieces(piece_model()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", remove_benchmark),
    ("pieces", encode_pieces),
]

#: SQL cannot express the models and the byte-level stages; toxicity is tested against its query, the others against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
