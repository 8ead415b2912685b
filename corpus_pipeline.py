"""A corpus pipeline of five stages over `documents`; counted as part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import shared_path, table
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.near_dup import drop_near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality import keep_good
from tessera.llm.suffix_dedup import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from a bounded sample of labelled ones."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each class of near duplicates."""
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes or more that an earlier document has; texts may end up shorter, or empty."""
    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the benchmark's passages make up a twentieth of, or more.

    The stage before cuts a passage from all documents but the first that has it, so that little of it may be left
    here; a document goes if its text in `documents`, before any cut, is contaminated, or the text that is left.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: a row per piece, with its sequence and place."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL expresses no trained classifier and no tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's rows written to the shared folder and read again as the next one's.

    Null and empty texts pass the quality stage by the score of a text without words, and are never duplicates; rows
    that repeat a doc_id are one document from the second stage on, those without a doc_id stay apart; other columns
    keep their values up to the last stage, which returns pieces. No documents give no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
