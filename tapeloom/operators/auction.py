"""The call auction and the closing price, declared with windows.

``by`` names the columns of one auction: ("symbol",), or ("day", "symbol") for orders of several sessions.

The auction of every security runs at once: running sums over price levels give
demand and supply, a row number picks the price, and pairing unites the cumulative
ends of buyers and sellers into one ordered set of break points, so no range join is needed.
Input: (symbol, order_number, side 'B'/'S', price, quantity, market, priority).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BY = ("symbol",)


def auction_curve(orders: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(symbol, price, demand, supply, volume, imbalance) at every positive limit price of a security."""
    buy = F.col("side") == "B"
    q = F.col("quantity")
    part = lambda c: F.sum(F.when(c, q).otherwise(0))
    # Market orders stand on a level of their own, below all prices (null sorts first)
    level = F.when(~F.col("market"), F.col("price"))
    levels = orders.groupBy(*by, level.alias("price")).agg(part(buy).alias("b"), part(~buy).alias("s"))
    up = Window.partitionBy(*by).orderBy(F.col("price").asc_nulls_first())
    to_here = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    below = F.coalesce(F.sum(F.when(F.col("price").isNotNull(), F.col("b"))).over(to_here), F.lit(0)) - F.col("b")
    demand = F.sum("b").over(whole) - below
    supply = F.sum("s").over(to_here)
    out = levels.select(*by, "price", F.when(F.col("price").isNotNull(), demand).alias("demand"), supply.alias("supply"))
    return out.where("price > 0").withColumn("volume", F.least("demand", "supply")).withColumn("imbalance", F.abs(F.col("demand") - F.col("supply")))


def auction_candidates(orders: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Prices of greatest volume and, among those, of least imbalance."""
    curve = auction_curve(orders, by).where("volume > 0")
    best = Window.partitionBy(*by).orderBy(F.desc("volume"), F.asc("imbalance"))
    return curve.withColumn("_r", F.rank().over(best)).where("_r = 1").drop("_r")


def auction_price(orders: DataFrame, previous_close: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """(symbol, price, volume, imbalance): of several candidates the nearest to the previous close, then the lowest.

    ``previous_close``: (symbol, previous_close), one row a symbol.
    """
    found = auction_candidates(orders, by)
    near: Column = F.lit(0)
    if previous_close is not None:
        found = found.join(previous_close.select(*by, "previous_close"), list(by), "left")
        near = F.coalesce(F.abs(F.col("price") - F.col("previous_close")), F.lit(0))
    w = Window.partitionBy(*by).orderBy(near, F.asc("price"))
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "price", "volume", "imbalance")


def _sides(orders: DataFrame, prices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orders that can trade at their security's price, with the running quantity range [start, end) of their side."""
    at = orders.join(prices.select(*by, F.col("price").alias("auction_price")), list(by))
    buy = F.col("side") == "B"
    good = F.col("market") | F.when(buy, F.col("price") >= F.col("auction_price")).otherwise(F.col("price") <= F.col("auction_price"))
    at = at.where(good).withColumn("_key", F.when(F.col("market"), 0).otherwise(F.when(buy, -F.col("price")).otherwise(F.col("price"))))
    rank = Window.partitionBy(*by, "side").orderBy("market", "_key", "priority", "order_number")
    end = F.sum("quantity").over(rank.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return at.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("quantity"))


def auction_trades(orders: DataFrame, prices: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """(symbol, buy_order_number, sell_order_number, price, quantity) of the call auction.

    Every end of a buyer's or seller's range is a break point; between two neighbours trades one pair, whose
    ids are the next ones to end on either side.
    """
    prices = auction_price(orders, by=by) if prices is None else prices
    ranged = _sides(orders, prices, by).where("quantity > 0")
    buy = F.col("side") == "B"
    points = ranged.groupBy(*by, "auction_price", F.col("_end").alias("point")).agg(
        F.max(F.when(buy, F.col("order_number"))).alias("b"), F.max(F.when(~buy, F.col("order_number"))).alias("s")
    )
    up = Window.partitionBy(*by).orderBy("point")
    # From the top down, so that the frame only grows: a frame that shrinks would be summed anew for every row
    down = Window.partitionBy(*by).orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = points.select(
        *by,
        F.last("b", ignorenulls=True).over(down).alias("buy_order_number"),
        F.last("s", ignorenulls=True).over(down).alias("sell_order_number"),
        F.col("auction_price").alias("price"),
        (F.col("point") - F.coalesce(F.lag("point").over(up), F.lit(0))).alias("quantity"),
    )
    return out.where("buy_order_number is not null and sell_order_number is not null")


def auction_leftovers(orders: DataFrame, prices: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """(symbol, order_number, side, price, market, remaining) of orders the auction leaves something of."""
    trades = auction_trades(orders, prices, by)
    sides = [trades.select(*by, F.col(f"{s}_order_number").alias("order_number"), "quantity") for s in ("buy", "sell")]
    done = sides[0].unionAll(sides[1]).groupBy(*by, "order_number").agg(F.sum("quantity").alias("_done"))
    left = F.col("quantity") - F.coalesce(F.col("_done"), F.lit(0))
    out = orders.join(done, [*by, "order_number"], "left").withColumn("remaining", left)
    return out.where("remaining > 0").select(*by, "order_number", "side", "price", "market", "remaining")


def closing_price(fills: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(symbol, closing_price): the last half hour's average to the nearest step of 5, else the last trade's price.

    ``fills``: (symbol, txn_time, trade_price, trade_quantity, seq); seq orders a security's trades.
    """
    tod = F.hour("txn_time") * 3600 + F.minute("txn_time") * 60 + F.second("txn_time")
    late = (tod >= 15 * 3600) & (tod < 15 * 3600 + 1800)
    got = fills.groupBy(*by).agg(
        F.sum(F.when(late, F.col("trade_price") * F.col("trade_quantity"))).alias("pq"),
        F.sum(F.when(late, F.col("trade_quantity"))).alias("q"),
        F.max_by("trade_price", "seq").alias("last"),
    )
    return got.select(*by, F.expr("if(q > 0, ((pq div q) + 2) div 5 * 5, last)").cast("bigint").alias("closing_price"))
