"""The corpus pipeline: toxic documents go, then copies, then near copies; sources are mixed to their weights and packed.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and is written as Parquet before the next reads it.  All but the last
return the columns of ``documents``.  Rows are told apart by themselves, so
repeated and null ids are documents like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from gridloom.llm.shared import materialize, table
from gridloom.llm.subwords import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network (fitted on the training labels of the given rows) scores below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id (null ids last)."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the n-gram join the row with the smallest doc_id (null ids last)."""
    return jaccard_join.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; one that it takes several times is repeated."""
    return mixing.mixed_rows(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]
#: SQL cannot express the stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "_"))
    return docs
