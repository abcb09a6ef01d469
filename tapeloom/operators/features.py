"""Derived columns and summaries of orders, trades and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.values import micros_of_timestamp


def is_iceberg(orders: DataFrame) -> DataFrame:
    """``orders`` with ``is_iceberg``: something, but not all, is disclosed."""
    return orders.withColumn("is_iceberg", (F.col("volume_disclosed") > 0) & (F.col("volume_disclosed") < F.col("volume_original")))


def buyer_aggressed(trades: DataFrame) -> DataFrame:
    """``trades`` with ``buyer_aggressed``: the buy order has the later number."""
    return trades.withColumn("buyer_aggressed", F.col("buy_order_number") > F.col("sell_order_number"))


def flow_features(orders: DataFrame, by: list[str], order: list[str], value: str, signed_by: str = "buy_sell", window: int = 100) -> DataFrame:
    """Signed volume, its running sum (order-flow imbalance), rolling mean and difference, in order within ``by``.

    The rolling mean is null until ``window`` rows are there, the difference on the first row.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    last = w.rowsBetween(-(window - 1), 0)
    signed = F.when(F.col(signed_by) == "B", F.col(value)).otherwise(-F.col(value))
    out = orders.withColumn("signed_volume", signed)
    return out.withColumns(
        {
            "ofi": F.sum("signed_volume").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "rolling_mean": F.when(F.count(value).over(last) == window, F.avg(value).over(last)),
            "difference": F.col(value) - F.lag(value).over(w),
        }
    )


def fill_rate_denominator(orders: DataFrame) -> DataFrame:
    """(symbol, order_number, max_volume): the largest quantity an order ever carried."""
    return orders.groupBy("symbol", "order_number").agg(F.max("volume_original").alias("max_volume"))


def symbol_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("symbol").agg(F.count("*").alias("n"))


def top_symbols(trades: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` symbols of greatest volume; ties by name."""
    total = trades.groupBy("symbol").agg(F.sum("trade_quantity").alias("volume"), F.count("*").alias("trades"))
    return total.orderBy(F.desc("volume"), "symbol").limit(n)


def interval_counts(orders: DataFrame, interval: str = "1 second") -> DataFrame:
    """(symbol, start, entries, cancels, modifies) in intervals of the clock."""
    of = lambda k: F.count_if(F.col("activity_type") == k)
    got = orders.groupBy("symbol", F.window("txn_time", interval).alias("w")).agg(of(1).alias("entries"), of(3).alias("cancels"), of(4).alias("modifies"))
    return got.select("symbol", F.col("w.start").alias("start"), "entries", "cancels", "modifies")


def clock_boundaries(orders: DataFrame, seconds: int) -> DataFrame:
    """(symbol, boundary): every multiple of the interval after a symbol's first event, up to its last."""
    step = seconds * 1_000_000
    timed = orders.select("symbol", micros_of_timestamp(F.col("txn_time")).alias("_m"))
    ends = timed.groupBy("symbol").agg(F.expr(f"min(_m) div {step} + 1").alias("a"), F.expr(f"max(_m) div {step}").alias("b"))
    out = ends.where("a <= b").select("symbol", F.explode(F.sequence("a", "b")).alias("k"))
    return out.select("symbol", F.expr(f"timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast(k * {seconds} as decimal(18,6)))").alias("boundary"))


def depth(resting: DataFrame, n: int) -> DataFrame:
    """(symbol, side, level, price, visible, hidden) of the ``n`` best levels of a table of resting orders."""
    levels = resting.groupBy("symbol", "side", "price").agg(F.sum("visible").alias("visible"), F.sum("hidden").alias("hidden")).where("visible > 0")
    best: Column = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("symbol", "side").orderBy(best)
    return levels.withColumn("level", F.row_number().over(w)).where(F.col("level") <= n).select("symbol", "side", "level", "price", "visible", "hidden")


def touch_composition(resting: DataFrame) -> DataFrame:
    """What stands at the best price of each side: (symbol, side, price, algo_qty, custodian_qty, iceberg_qty, iceberg_hidden, orders)."""
    best: Column = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("symbol", "side").orderBy(best)
    top = resting.where("visible > 0").withColumn("_r", F.rank().over(w)).where("_r = 1")
    q = lambda c: F.sum(F.when(c, F.col("visible")).otherwise(0))
    return top.groupBy("symbol", "side", "price").agg(
        q(F.col("algo_indicator").isin(0, 2)).alias("algo_qty"),
        q(F.col("client_identity") == 1).alias("custodian_qty"),
        q(F.col("hidden") > 0).alias("iceberg_qty"),
        F.sum("hidden").alias("iceberg_hidden"),
        F.count("*").alias("orders"),
    )


def unchanged_touch(snapshots: DataFrame) -> DataFrame:
    """(symbol, snapshots, unchanged): share of snapshots whose best prices equal the ones before."""
    w = Window.partitionBy("symbol").orderBy("snapshot_time")
    now = F.struct("best_bid", "best_ask")
    got = snapshots.withColumn("_same", now.eqNullSafe(F.lag(now).over(w)).cast("double")).withColumn("_k", F.row_number().over(w))
    return got.groupBy("symbol").agg(F.count("*").alias("snapshots"), F.avg(F.when(F.col("_k") > 1, F.col("_same"))).alias("unchanged"))
