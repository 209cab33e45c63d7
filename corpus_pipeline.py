"""The corpus pipeline: from raw documents to mixed shards.

Each stage takes what its predecessor kept and returns the columns of ``documents``, the last one
the place of every document:

1. quality: documents that the Kneser-Ney model finds too surprising for their language go.
2. near_duplicates: one document of each group of near-duplicates stays, that with the smallest id.
3. decontamination: passages of benchmark items are cut out; a document that is mostly such goes.
4. mixing: documents are taken once or twice so that the sources meet their targets, or left out.
5. sharding: runs of a Hilbert curve.

Null texts pass stages 1 to 3 and have no words to be taken in stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, jaccard, mixing, quality, sharding
from cairn.llm.common import materialise, table
from cairn.llm.queries import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.document_shards(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", cut_benchmarks),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: The model, the flow and the curve have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written before the next one reads it."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
