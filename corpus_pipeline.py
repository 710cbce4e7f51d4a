"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again for the next one; what the stage before it wrote is deleted then. All but the last
return the columns of documents. Null, empty and repeated rows, empty tables and clashing columns fare as the
operators' docstrings say: a stage hands them on to its operator as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from vellum.llm.common import Scratch, prepare, read, temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models (fitted on the labelled ones among them) reject go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is similar to go, and documents that lose all their words by it."""
    return line_dedup.drop_repeated_lines(docs, least=line_dedup.EVERY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in windows of benchmark items go."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Kneser-Ney models and retrieval packing are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; the result is a written table too."""
    scratch = Scratch(prepare(spark), "pipeline")
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with temporary():
            docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = [docs]
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
