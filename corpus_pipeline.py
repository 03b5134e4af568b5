"""The training corpus: documents to packed sequences in five stages, each kept as Parquet before the next reads it.

Every stage sees all that its predecessor kept. The first four return the columns of documents; the last returns pieces
of sequences. Rows that none of them rejects stay: texts whose language can't be told go, then lines that match an
earlier line (and documents of which no line is left), then all but one document of each group of near copies, then
documents of which a twentieth or more are benchmark windows (others lose the windows themselves), and what is left is
packed. Tables without rows pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import decontaminate as contamination
from parley.llm import language as languages
from parley.llm import lines, near_copies, packing
from parley.llm.tables import keep, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return languages.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs


#: Mixtures, alignments and packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
