"""Labelling the exchange's trades with the order event that caused each: as-of joins and a CASE."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.values import micros_of_timestamp


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, out: str) -> DataFrame:
    """``left`` with ``out``: the right row's ``value`` of the latest ``at`` not after the left row's, for equal ``by``.

    Both sides are united and one window carries the last value forward: a single shuffle on ``by``, no
    pairs.  A right row at the very time of a left row counts as before it; of right rows at one time the greatest value counts.
    """
    rest = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_tag"), F.struct(*rest).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_tag"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_at", "_tag", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = a.unionByName(b).withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_tag = 1")
    return joined.select(*[F.col("_at").alias(c) if c == at else F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in left.columns], out)


def label_trades(trades: DataFrame, orders: DataFrame) -> DataFrame:
    """(symbol, kind, event_ts, aggressor, resting, price, quantity, trade_number, trade_ts, buy, sell) of every trade.

    The aggressor is the side whose latest entry or modify is later.  Kind: A before 09:15, '?' where that is undecided, else C.
    An optional column ``session_time`` of the trades decides that in place of ``txn_time``.
    """
    events = orders.where("activity_type in (1, 4)").select("symbol", F.col("order_number").alias("o"), micros_of_timestamp(F.col("txn_time")).alias("ts"))
    events = events.withColumn("event", F.col("ts"))
    clock = F.coalesce("session_time", "txn_time") if "session_time" in trades.columns else F.col("txn_time")
    t = trades.select(
        "symbol",
        F.col("trade_number").alias("n"),
        micros_of_timestamp(F.col("txn_time")).alias("ts"),
        F.col("buy_order_number").alias("b"),
        F.col("sell_order_number").alias("s"),
        F.col("trade_price").alias("p"),
        F.col("trade_quantity").alias("q"),
        (F.date_format(clock, "HH:mm:ss") < "09:15:00").alias("early"),
    )
    for side in ("b", "s"):
        t = asof_join(t, events.withColumnRenamed("o", side), ["symbol", side], "ts", "event", f"{side}_ts")
    bought = F.col("b_ts") > F.col("s_ts")
    pick = lambda x, y: F.when(bought, F.col(x)).otherwise(F.col(y))
    unknown = F.col("b_ts").isNull() | F.col("s_ts").isNull() | (F.col("b_ts") == F.col("s_ts"))
    kind = F.when(F.col("early"), "A").when(unknown, "?").otherwise("C")
    return t.select(
        "symbol", kind.alias("kind"), pick("b_ts", "s_ts").alias("event_ts"), pick("b", "s").alias("aggressor"), pick("s", "b").alias("resting"),
        F.col("p").alias("price"), F.col("q").alias("quantity"), F.col("n").alias("trade_number"), F.col("ts").alias("trade_ts"), F.col("b").alias("buy"), F.col("s").alias("sell"),
    )


def write_labels(labels: DataFrame, path: str) -> None:
    """CSV without header or symbol, in trade order."""
    labels.orderBy("trade_number").drop("symbol").write.mode("overwrite").option("header", False).csv(path)
