"""The corpus pipeline: quality rules, toxicity, MinHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which run() writes
as Parquet in the shared folder and reads again for the next; a stage's table goes once the next is written. All but the
last return the columns that they got, those of documents and any others, whatever their names; mixing returns a
document as often as the mix takes it; packing returns the pieces of sequences, one row each.

Null and empty texts fail the quality rules; so do all rows without text. Null ids, sources and languages stay as they
are; repeated rows are near duplicates of each other, and one doc_id stays with all its rows. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import minhash, mixing, packing, quality, toxicity
from passagemill.llm.shared import drop, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.filtered(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels of documents that are still there."""
    return toxicity.filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_rules),
    ("toxicity", toxic_documents),
    ("minhash", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The toxicity model and best-fit decreasing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
