"""The corpus pipeline: documents to a training mix, in five stages.

Each stage reads all that the one before kept, and its result is written before the next
one starts, so that a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmend.llm.common import Workspace, table
from tabmend.llm.decontaminate import decontaminate
from tabmend.llm.line_dedup import dedup_lines
from tabmend.llm.mixing import mix_sources
from tabmend.llm.near_dedup import first_copies
from tabmend.llm.quality_model import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has."""
    kept = dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return first_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    marked = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter(~F.col("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's copies in the mix, 0 for those left out."""
    return mix_sources(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark),
    ("mixing", mix),
]

#: The classifier and the mix are iterative; tests compare the operators of the other three stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
