"""The contract queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import decontam, mixing, oracle, passages, quality_eb, quality_rules, sharding, simhash, suffix_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def categories() -> dict:
    """Label columns in chain order: unclean text is easier to tell and helps to read the toxic label.  Made per call, for columns need a session."""
    return {"unclean": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.with_quality(docs).select(*cols)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select(F.col("row_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.with_toxicity(docs, table(spark, sf_dir, "labels"), categories(), reject="toxic")
    return out.select("doc_id", "p_unclean", "p_toxic", "toxic", "kept")


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_eb.with_site_quality(docs, table(spark, sf_dir, "labels"), F.col("quality"), F.col("source"), F.col("lang"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.near_duplicate_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "n_links", "repeats_ids", "n_words", "n_repeated_words", "n_spans")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_quality_rules, op2_warc, op3_suffix_dedup, op4_toxicity, op5_site_quality, op6_simhash, op7_sharding, op8_decontamination, op9_passages, op10_mixing]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """SQL of queries 1, 2, 3, 7, 8 and 10; the others rest on hashes or models that SQL has not."""
    return oracle.oracle_sql()
