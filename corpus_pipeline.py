"""Pipeline over a document table: filter, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm import line_dedup, near_dedup, packing, quality_classifier, source_mixing
from haulmark.llm.tables import keep, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where the documents have it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts; it learns from ``docs`` and the labels."""
    machine = quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, machine)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated runs of lines."""
    return _measured(line_dedup.deduplicated(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies."""
    return near_dedup.deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _measured(source_mixing.mixed(docs))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of a document in a bin."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near_copies), ("source mixing", mixing), ("best-fit packing", bins)]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``; every stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
