"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; all but the last return the
columns of documents. `run` writes each stage's result to the shared folder and reads it again, so that a lost executor
costs no more than the stage at work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spandrel.llm.common import read_table, store
from spandrel.llm.lines import dedup_lines
from spandrel.llm.mixing import Target, mix
from spandrel.llm.near_dup import drop_near_duplicates
from spandrel.llm.packing import pack
from spandrel.llm.quality_gam import keep_quality

#: As even a mixture as one and a half passes over the smallest sources allow, and at least one over each source.
MIXTURE = Target(entropy=1.0, repetitions=1.5, budget=None, seed=7)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among `docs`, does not reject."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least three hold, but for the last holder."""
    return dedup_lines(docs, least=20, documents=3)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, words=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources more often."""
    return mix(docs, MIXTURE)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return pack(docs, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The classifier is fitted, so SQL cannot express the result; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
