"""Parsed orders and trades: Parquet written by ``parse`` or by anything with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.errors import FeedError
from tapeloom.sources import storage

REQUIRED = ("symbol", "txn_time", "order_number", "activity_type", "buy_sell", "limit_price", "volume_disclosed", "volume_original", "algo_indicator", "client_identity")
OPTIONAL = ("ioc_flag", "mkt_order_flag", "stop_loss_flag", "trigger_price")


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise FeedError(f"these columns are missing: {', '.join(missing)}")


def read_parsed(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """A Parquet file or a directory of ``symbol=*`` partitions; a symbol list prunes partitions.

    Symbols stay text even where they look like numbers; unsigned columns of other writers become longs.
    """
    inferred = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        df = spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", inferred)
    wide = {f.name: F.col(f.name).cast("bigint") for f in df.schema if f.dataType.simpleString() == "decimal(20,0)"}
    df = df.withColumns(wide) if wide else df
    return df.where(F.col("symbol").isin(symbols)) if symbols else df


def read_orders(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    df = read_parsed(spark, path, symbols)
    require_columns(df)
    return df


def sessions(spark: SparkSession, root: str, orders: str = "segment=cm/kind=orders", trades: str = "segment=cm/kind=trades") -> list[tuple[str, str, str]]:
    """(date, orders directory, trades directory) of every session that has both."""
    have = set(storage.children(spark, f"{root}/{trades}"))
    days = [d for d in storage.children(spark, f"{root}/{orders}") if d.startswith("date=") and d in have]
    return [(d.removeprefix("date="), f"{root}/{orders}/{d}", f"{root}/{trades}/{d}") for d in days]


def read_previous_close(spark: SparkSession, path: str) -> dict[str, int]:
    """``symbol,price`` lines in paise; a header is tolerated on the first line only."""
    out: dict[str, int] = {}
    for n, line in enumerate(storage.read_text(spark, path).splitlines()):
        line = line.strip()
        if not line:
            continue
        symbol, comma, price = line.partition(",")
        if not comma:
            raise FeedError(f"{path}:{n + 1}: expected symbol,price")
        try:
            out[symbol.strip()] = int(price.strip())
        except ValueError:
            if n:
                raise FeedError(f"{path}:{n + 1}: a price is whole paise, not {price.strip()!r}") from None
    return out
