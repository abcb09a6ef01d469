"""A corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes to the shared folder and reads back as the next stage's documents.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontam, mixing, sharding, simhash, toxicity
from tapeloom.llm.queries import categories, table
from tapeloom.llm.util import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    out = toxicity.with_toxicity(rows, table(spark, sf_dir, "labels"), categories(), reject="toxic")
    return out.where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id, of those with one id that with the smallest text hash."""
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a share of benchmark words that makes them contaminated."""
    rows = docs.select("text", F.struct("*").alias("row"))
    out = decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=["row"])
    return out.where("not contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; the one on a source's cut is taken whole."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document of the mix."""
    return sharding.assign_shards(docs, n_shards=24)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Classifiers, XXH64 fingerprints and hash-random orders have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
