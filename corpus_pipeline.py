"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waybridge.llm.common import read
from waybridge.llm.decontaminate import drop_contaminated
from waybridge.llm.language import keep_identified
from waybridge.llm.lines import drop_boilerplate
from waybridge.llm.packing import pack_documents
from waybridge.llm.simhash import RADIUS, drop_near_duplicates
from waybridge.session import materialized


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts far from every language profile."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of a source out of its texts; every document stays.

    Copies of a text are one page here, for the next stage keeps one of them with its lines.
    """
    return drop_boilerplate(docs, copies=False).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Texts are linked by their SimHash fingerprints; exactly compared sets of shingles add
    the links that fingerprints miss.
    """
    return drop_near_duplicates(docs, radius=RADIUS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised ones included."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises what is left and packs it into sequences."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: language profiles, similarity groups and packing have no SQL form; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each reads what the one before wrote."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialized(docs, f"stage-{name}")
    return docs
