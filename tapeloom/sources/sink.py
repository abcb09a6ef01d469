"""Partitioned Parquet with a manifest: the ``parse`` operation."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import __version__
from tapeloom.errors import FeedError
from tapeloom.sources import storage
from tapeloom.sources.feed import open_feed

COMPRESSION = {"zstd": "zstd", "snappy": "snappy", "none": "uncompressed", "uncompressed": "uncompressed"}
DEFAULT_ROW_GROUP_ROWS, DEFAULT_PAGE_KB = 256_000, 64


def compression_of(name: str) -> str:
    if name.lower() not in COMPRESSION:
        raise FeedError(f"unknown compression {name!r}; use zstd, snappy or none")
    return COMPRESSION[name.lower()]


@dataclass
class ParseRequest:
    """One parse: input, output root and options."""

    input: str
    out: str
    layout: str | None = None
    date: str | date | None = None
    select: list[str] | None = None
    where: str = ""
    partition_by: str | None = "symbol"
    compression: str = "snappy"
    row_group_rows: int = DEFAULT_ROW_GROUP_ROWS
    data_page_kb: int = DEFAULT_PAGE_KB
    strict: bool = True
    verify_trigger: bool = True
    max_records: int | None = None
    note: str | None = None
    # Accepted for the sake of run specs; Spark plans threads, chunks and memory itself.
    threads: int | None = None
    chunk_mb: int | None = None
    max_buffered_mb: int | None = None


def _partitioned(df: DataFrame, column: str | None) -> DataFrame:
    """Rows of a partition in one file and in feed order; each task has one writer open at a time."""
    if column is None:
        return df.repartition(1).sortWithinPartitions("seq")
    return df.repartition(column).sortWithinPartitions(column, "seq")


def run_parse(spark: SparkSession, req: ParseRequest) -> dict:
    """Parse into ``<out>/segment=/kind=/date=/<column>=/`` and write the manifest; returns the report."""
    began = time.time()
    codec = compression_of(req.compression)
    by = None if req.partition_by in (None, "", "none") else req.partition_by
    feed = open_feed(
        spark, req.input, layout=req.layout, day=req.date, where=req.where, select=req.select, strict=req.strict,
        verify_trigger=req.verify_trigger, max_records=req.max_records, with_seq=True, observe=True,
    )
    if by is not None:
        if by not in feed.columns:
            raise FeedError(f"partition column {by!r} must be selected")
        if feed.version.field(by).type != "str":
            raise FeedError(f"partition column {by!r} must be text")
    root = f"{req.out.rstrip('/')}/segment={feed.layout.segment.lower()}/kind={feed.layout.kind}/date={feed.day}"
    width = 8 * len(feed.columns)
    writer = (
        _partitioned(feed.df, by).drop("seq").write.mode("overwrite").option("compression", codec)
        .option("parquet.block.size", str(max(1 << 20, req.row_group_rows * width))).option("parquet.page.size", str(req.data_page_kb * 1024))
    )
    (writer.partitionBy(by) if by else writer).parquet(root)
    stats = feed.stats()
    written = spark.read.option("basePath", root).parquet(root) if stats["rows_emitted"] else None
    parts = []
    if written is not None:
        key = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
        counts = written.groupBy(key.alias("key"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))
        counts = counts.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).orderBy("key")
        parts = [r.asDict() for r in counts.collect()]  # one row per output partition
    elapsed = time.time() - began
    manifest = {
        "tool_version": __version__,
        "created_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "source_path": req.input,
        "source_bytes": sum(storage.size_of(spark, f) for f in feed.files),
        "bytes_decompressed": stats["bytes_decompressed"],
        "layout_id": feed.layout.id,
        "spec_version": feed.version.spec_version,
        "record_length": feed.version.record_length,
        "layout_verified": feed.version.verified,
        "session_date": str(feed.day),
        **({"note": req.note} if req.note is not None else {}),
        "filter": req.where or "",
        "selected_fields": feed.columns,
        "partition_by": by,
        "strict": req.strict,
        **{k: stats[k] for k in ("rows_read", "rows_emitted", "rows_filtered", "rows_malformed")},
        "elapsed_secs": elapsed,
        "partitions": parts,
    }
    path = write_manifest(spark, req.out, manifest)
    return {
        **stats,
        "partitions": len(parts),
        "elapsed_secs": elapsed,
        "manifest": path,
        "layout": feed.layout.id,
        "spec_version": feed.version.spec_version,
        "record_length": feed.version.record_length,
        "threads": spark.sparkContext.defaultParallelism,
        "memory_peak_bytes": None,
        "memory_limit_bytes": None,
    }


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> str:
    """One manifest per layout and date, so sessions of several feeds share a root."""
    path = f"{root.rstrip('/')}/_manifest.{manifest['layout_id']}.{manifest['session_date']}.json"
    storage.write_text(spark, path, json.dumps(manifest, indent=2))
    return path


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(storage.read_text(spark, path))


def yield_ratio(manifest: dict) -> float:
    """Rows that reached the output, of those read."""
    return manifest["rows_emitted"] / manifest["rows_read"] if manifest["rows_read"] else 0.0
