"""Comparing generated trades with the exchange's own.

Both sides are counted together by trade key in one shuffle; pairs, orders and securities are sums over those counts.
Nothing is numbered, ordered or collected.  Trades have (symbol, txn_time, buy_order_number, sell_order_number,
trade_price, trade_quantity); with ``by`` = ("day", "symbol") several sessions are compared at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRADE = ("buy_order_number", "sell_order_number", "trade_price", "trade_quantity")
KEY = ("symbol", *TRADE)
CONTINUOUS = "09:15:00"


def since(trades: DataFrame, start: str | None) -> DataFrame:
    """Trades from a time of day on."""
    return trades if start is None else trades.where(F.date_format("txn_time", "HH:mm:ss") >= start)


def counted(actual: DataFrame, replayed: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(by.., trade key, a, r): how often each trade is among the actual and among the generated ones."""
    one = lambda t, a, r: t.select(*by, *TRADE, F.lit(a).alias("a"), F.lit(r).alias("r"))
    return one(actual, 1, 0).unionAll(one(replayed, 0, 1)).groupBy(*by, *TRADE).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))


def pair_sums(counts: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per order pair: trades, equal trades, and quantity and value on either side."""
    total = lambda n, x: F.sum(F.col(n) * x)
    q, value = F.col("trade_quantity"), F.col("trade_quantity") * F.col("trade_price")
    return counts.groupBy(*by, "buy_order_number", "sell_order_number").agg(
        F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum(F.least("a", "r")).alias("exact"),
        total("a", q).alias("aq"), total("r", q).alias("rq"), total("a", value).alias("av"), total("r", value).alias("rv"),
    )


def order_sums(pairs: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per order, on whichever side: trades and quantity among the actual (a, aq) and the generated ones (r, rq)."""
    sides = pairs.select(*by, F.explode(F.array("buy_order_number", "sell_order_number")).alias("order_number"), "a", "r", "aq", "rq")
    return sides.groupBy(*by, "order_number").agg(*[F.sum(c).alias(c) for c in ("a", "r", "aq", "rq")])


_PAIRS = {
    "trades": F.sum,
    "exact": F.sum,
    "pairs": F.count_if,
    "pairs_exact": F.count_if,
    "volume": F.sum,
    "volume_replayed": F.sum,
}


def _of_pairs(pairs: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Measures per security, for those that have actual trades."""
    known = F.col("a") > 0
    what = {
        "trades": F.col("a"),
        "exact": F.col("exact"),
        "pairs": known,
        "pairs_exact": known & (F.col("r") > 0) & (F.col("aq") == F.col("rq")) & (F.col("av") == F.col("rv")),
        "volume": F.col("aq"),
        "volume_replayed": F.col("rq"),
    }
    out = pairs.groupBy(*by).agg(*[_PAIRS[n](what[n]).alias(n) for n in names], F.sum("a").alias("_known"))
    return out.where("_known > 0").drop("_known")


def exact_matches(actual: DataFrame, replayed: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(by.., trades, exact): trades that a generated one equals in all key columns, each used once."""
    return _of_pairs(pair_sums(counted(actual, replayed, by), by), by, ("trades", "exact"))


def pair_matches(actual: DataFrame, replayed: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(by.., pairs, pairs_exact): order pairs whose quantity and value agree."""
    return _of_pairs(pair_sums(counted(actual, replayed, by), by), by, ("pairs", "pairs_exact"))


def volumes(actual: DataFrame, replayed: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(by.., volume, volume_replayed)."""
    return _of_pairs(pair_sums(counted(actual, replayed, by), by), by, ("volume", "volume_replayed"))


def _of_orders(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    known = F.col("a") > 0
    same = known & (F.col("r") > 0) & (F.col("aq") == F.col("rq"))
    out = order_sums(pairs, by).groupBy(*by).agg(F.count_if(known).alias("orders"), F.count_if(same).alias("orders_exact"))
    return out.where("orders > 0")


def order_matches(actual: DataFrame, replayed: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(by.., orders, orders_exact): orders whose traded quantity agrees."""
    return _of_orders(pair_sums(counted(actual, replayed, by), by), by)


MEASURES = ("trades", "exact", "pairs", "pairs_exact", "orders", "orders_exact", "volume", "volume_replayed")


def verify(actual: DataFrame, replayed: DataFrame, continuous_only: bool = False, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per security of ``actual`` with all ``MEASURES``, in order of ``by``."""
    start = CONTINUOUS if continuous_only else None
    pairs = pair_sums(counted(since(actual, start), since(replayed, start), by), by)
    out = _of_pairs(pairs, by, tuple(_PAIRS)).join(_of_orders(pairs, by), list(by))
    return out.select(*by, *MEASURES).orderBy(*by)


def with_totals(report: DataFrame) -> DataFrame:
    """The report and a row ALL that sums it."""
    keys = [c for c in report.columns if c not in MEASURES]
    total = report.agg(*[F.sum(m).alias(m) for m in MEASURES])
    return report.unionByName(total.select(*[(F.lit("ALL") if k == "symbol" else F.lit(None)).cast(report.schema[k].dataType).alias(k) for k in keys], *MEASURES))


def missed(actual: DataFrame, replayed: DataFrame) -> DataFrame:
    """Trades that no generated one equals (as a set)."""
    return actual.join(replayed.select(*KEY).distinct(), list(KEY), "left_anti")


def report_lines(session: str, rows: list) -> list[str]:
    """The report as tab-separated text: each measure found of its total."""
    of = (("exact", "trades"), ("pairs_exact", "pairs"), ("orders_exact", "orders"), ("volume_replayed", "volume"))
    return ["\t".join(("day", "security", *(total for _, total in of)))] + [
        "\t".join((session, r["symbol"], *(f"{r[found]}/{r[total]}" for found, total in of))) for r in rows
    ]
