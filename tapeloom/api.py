"""The engine's functions by name, each taking a session where it reads data."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date as Date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tapeloom import __version__
from tapeloom.errors import FeedError, WhereError
from tapeloom.operators.replay import build_books, load_orders
from tapeloom.operators.replay import replay_fills as _replay_fills
from tapeloom.plans.predicate import check_filter
from tapeloom.plans.runspec import load_spec, run_spec
from tapeloom.sources.feed import Feed, inspect, open_feed, probe, read_feed
from tapeloom.sources.layouts import describe, layouts, layouts_df, validate_layout
from tapeloom.sources.sink import ParseRequest, run_parse

__all__ = [
    "BatchReader", "Feed", "FeedError", "ParseRequest", "WhereError", "__version__", "build_books", "check_filter", "describe", "inspect", "iter_batches", "layouts", "layouts_df",
    "load_spec", "memory_estimate", "open_feed", "parse", "probe", "read_feed", "read_table", "replay_fills", "run_spec", "session", "to_pandas", "to_polars", "validate_layout",
]


def session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is used with; on a cluster, bring your own."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def parse(spark: SparkSession, input: str, out: str, **options) -> dict:
    """Parse a feed file into partitioned Parquet with a manifest; returns the report."""
    return run_parse(spark, ParseRequest(input, out, **options))


class BatchReader:
    """Arrow batches of a feed in order, one partition at a time on the driver.

    Counts are there when the iterator has ended; the first look at them takes a pass of its own, for a
    local iterator reports no metrics.
    """

    def __init__(self, spark: SparkSession, input: str, batch_rows: int = 65_536, **options):
        options.pop("chunk_mb", None)
        self._feed = open_feed(spark, input, observe=True, **{("day" if k == "date" else k): v for k, v in options.items()})
        self._rows = batch_rows
        self._ended = False
        self._counts: dict[str, int] = {}

    @property
    def schema(self):
        return self._feed.df.schema

    @property
    def record_length(self) -> int:
        return self._feed.version.record_length

    @property
    def bytes_read(self) -> int:
        return self.stats["bytes_decompressed"]

    @property
    def stats(self) -> dict[str, int]:
        if self._ended and not self._counts:
            self._feed.df.write.format("noop").mode("overwrite").save()
            self._counts = self._feed.stats()
        return self._counts

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self._feed.df.schema)
        held: list[dict] = []
        for row in self._feed.df.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict())
            if len(held) >= self._rows:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        self._ended = True
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


def iter_batches(spark: SparkSession, input: str, **options) -> Iterator[pa.RecordBatch]:
    return iter(BatchReader(spark, input, **options))


def _selected(spark: SparkSession, input: str, max_rows: int | None, options: dict) -> DataFrame:
    df = read_feed(spark, input, **{("day" if k == "date" else k): v for k, v in options.items()})
    return df if max_rows is None else df.limit(max_rows)


def read_table(spark: SparkSession, input: str, max_rows: int | None = None, **options) -> pa.Table:
    """The decoded rows as one Arrow table on the driver."""
    return _selected(spark, input, max_rows, options).toArrow()


def to_pandas(spark: SparkSession, input: str, max_rows: int | None = None, **options):
    return read_table(spark, input, max_rows, **options).to_pandas()


def to_polars(spark: SparkSession, input: str, max_rows: int | None = None, **options):
    """As a Polars frame, where Polars is installed."""
    try:
        import polars
    except ImportError:
        raise FeedError("polars is not installed") from None
    return polars.from_arrow(read_table(spark, input, max_rows, **options))


def replay_fills(spark: SparkSession, input: str, symbols: list[str] | None = None, previous_close: dict[str, int] | None = None, date: str | Date | None = None, where: str | None = "series == 'EQ'") -> DataFrame:
    """Every trade that replaying the orders of a session generates."""
    orders, by, _ = load_orders(spark, input, date, where, symbols)
    return _replay_fills(orders, previous_close, order_by=by)


def memory_estimate(partitions: int = 0) -> dict[str, int]:
    """Advisory only: Spark keeps one writer open per task and spills sorts, so partitions do not add up."""
    import os

    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    free = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_AVPHYS_PAGES")
    per, buffer = 2_621_440, 256 << 20
    limit = free * 7 // 10
    return {
        "available_bytes": free,
        "total_bytes": total,
        "default_footprint_limit": limit,
        "default_buffer_limit": buffer,
        "bytes_per_open_partition": per,
        "estimated_bytes": partitions * per + buffer,
        "partitions_that_fit": max(0, limit - buffer) // per,
    }
