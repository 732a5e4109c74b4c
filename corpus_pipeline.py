"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from tidemark.llm.common import Scratch, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below its threshold go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.kept_documents(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 percent of five-word shingles one document stays."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an exact match of a benchmark window go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place; see packing.pack()."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", dedup_exact),
    ("n-gram Jaccard join", dedup_near),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Trained rules, components and token ids have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`, each stage on all that the one before it kept.

    Stages act by row: one goes for its own text, also where ids repeat or are null, and of equal rows one stays. Null and
    empty texts are equal texts of which exact dedup keeps one, if the classifier kept any. Texts of any length are read
    whole. Further columns pass through the filtering stages. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
