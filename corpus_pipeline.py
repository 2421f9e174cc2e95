"""A training corpus from documents: toxicity, quality, exact copies, near copies, packing.

Each stage gets the documents that its predecessor kept. Rows with null ids or texts pass like any others (null
text counts as empty); an empty table gives an empty result; further columns of documents are kept until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import exact_dedup, labelled, near_dedup, packing, quality, toxicity
from quayside.llm._common import Scratch
from quayside.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below 0.5; it is learned from the labelled rows of ``sf_dir``."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = toxicity.fit(source, spark.read.parquet(f"{sf_dir}/labels.parquet"), labelled.crc_remainder("id", 5) != 0)
    return toxicity.drop_toxic(docs, lexicon)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(source, spark.read.parquet(f"{sf_dir}/labels.parquet"), labelled.crc_remainder("id", 3) != 1)
    return quality.drop_poor(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.keep_one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose bags of five-word shingles are linked by similarities of 0.8 or more, one."""
    return near_dedup.keep_one_of_each(docs, threshold=0.8, shingle=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return packing.pack_sequences(docs, tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: Learned scores, signatures and tokens aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
