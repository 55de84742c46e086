"""A corpus pipeline: from raw documents to packed ones, each stage written as Parquet and read again.

The stages, in order: documents without a known language go; of each group of near-duplicates (five-word
shingles, similarity 0.8 or more) one stays; documents that leak benchmark items go; personal data is
replaced; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutgraph.llm import decontamination, language, neardup, packing, pii
from cutgraph.llm.common import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter stay, with the language found as ``lang``; null, empty and letterless texts go."""
    return language.in_known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest doc_id stays; rows without doc_id or words stay, and all rows of a doc_id that stays."""
    return neardup.deduplicated(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark go; rows without doc_id or text stay."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in ``text`` becomes its kind in angle brackets, and ``n_chars`` the new length; every row stays, null texts as they are."""
    return pii.redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its bin; empty and null texts are one piece of no words."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's table is written, read by the next and then deleted."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the automata nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None
