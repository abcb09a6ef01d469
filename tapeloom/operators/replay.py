"""Replaying order messages through the book, one security and session at a time.

Plan: native extraction of the event columns -> one shuffle by (date, symbol) ->
sort by (date, symbol, seq) -> a streaming fold over the sorted rows.  The fold
reads Arrow batches and holds the state of one book; a session of any length passes through.
A security's session is one sequence by its nature and so one task; many securities and days spread out.
"""

from __future__ import annotations

import csv
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import date as Date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tapeloom.errors import FeedError
from tapeloom.functions.values import micros_of_timestamp, timestamp_of_micros
from tapeloom.operators.book import BUY, COUNTERS, DAY as MICROS_OF_DAY, LOOKAHEAD, SELL, Event, Fill, SymbolReplay, snapshot_columns
from tapeloom.shipping import ship
from tapeloom.sources import storage
from tapeloom.sources.feed import open_feed
from tapeloom.sources.layouts import parse_date
from tapeloom.sources.parsed import OPTIONAL, REQUIRED, read_parsed, require_columns
from tapeloom.sources.sink import compression_of

EVENT_COLUMNS = ("ts", "order", "activity", "side", "price", "quantity", "disclosed", "algo", "client", "ioc", "market", "stop", "trigger", "tod")
FILL_SCHEMA = "symbol string, txn_time timestamp_ntz, trade_price bigint, trade_quantity bigint, buy_order_number bigint, sell_order_number bigint, aggressor string"
FILL_DETAIL = ", incoming_order bigint, resting_order bigint, from_hidden boolean"
DEFAULT_LEVELS, DEFAULT_INTERVAL = 20, 1.0
STEP_ROWS = 8192
#: Counters of a book at the end of its session, where snapshots carry them.
TALLY = {"_events": "bigint", "_fills": "bigint", "_replenishments": "bigint", "_crossed": "bigint"}


def extract_events(orders: DataFrame, order_by: Column | str | None = None, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Event columns with (day, symbol, seq).  Rows that cannot be applied to a book are left out.

    ``seq`` is feed order and must be total: the column ``seq`` by default.  Books are kept per ``key``
    and day; further key columns are joined to the symbol with a slash.  An optional column ``session_time``
    gives the day and the time of day that decide the session where ``txn_time`` does not, as on a made tape that runs past the close.
    """
    require_columns(orders)
    ship(orders.sparkSession)
    seq = F.col("seq") if order_by is None else F.col(order_by) if isinstance(order_by, str) else order_by
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    code = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(255))
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in orders.columns else F.lit(False)
    side = F.substring("buy_sell", 1, 1)
    clock = F.col("txn_time").cast("timestamp_ntz")
    if "session_time" in orders.columns:
        clock = F.coalesce(F.col("session_time").cast("timestamp_ntz"), clock)
    made = orders.select(
        clock.cast("date").alias("day"),
        F.concat_ws("/", *key).alias("symbol") if len(key) > 1 else F.col(key[0]).alias("symbol"),
        seq.alias("seq"),
        micros_of_timestamp(F.col("txn_time").cast("timestamp_ntz")).alias("ts"),
        F.col("order_number").cast("bigint").alias("order"),
        F.col("activity_type").cast("int").alias("activity"),
        F.when(side == "B", BUY).when(side == "S", SELL).alias("side"),
        zero("limit_price").alias("price"),
        zero("volume_original").alias("quantity"),
        zero("volume_disclosed").alias("disclosed"),
        code("algo_indicator").alias("algo"),
        code("client_identity").alias("client"),
        flag("ioc_flag").alias("ioc"),
        flag("mkt_order_flag").alias("market"),
        flag("stop_loss_flag").alias("stop"),
        (zero("trigger_price") if "trigger_price" in orders.columns else F.lit(0).cast("bigint")).alias("trigger"),
        F.pmod(micros_of_timestamp(clock), F.lit(MICROS_OF_DAY)).alias("tod"),
    )
    return made.dropna(subset=["symbol", "ts", "order", "activity", "side"])


def in_feed_order(events: DataFrame) -> DataFrame:
    """One shuffle: every (day, symbol) in one task, sorted by seq."""
    return events.repartition("day", "symbol").sortWithinPartitions("day", "symbol", "seq")


def _fold(start: Callable[[str], SymbolReplay], emit: Callable[[SymbolReplay, list], list[tuple]], close: Callable[[SymbolReplay], list[tuple]], batch_of: Callable[[list[tuple], object], pa.RecordBatch]):
    """A function for ``mapInArrow`` over rows in feed order: a new replay at every change of (day, symbol)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, replay, last, rows = None, None, None, []
        for batch in batches:
            days, symbols, seqs = (batch.column(c).to_pylist() for c in ("day", "symbol", "seq"))
            if pa.types.is_struct(batch.schema.field("seq").type):
                seqs = [tuple(q.values()) for q in seqs]
            events = map(Event._make, zip(*(batch.column(c).to_pylist() for c in EVENT_COLUMNS)))
            for d, s, q, ev in zip(days, symbols, seqs, events):
                if (d, s) != now:
                    if replay is not None:
                        rows += emit(replay, replay.finish())
                        rows += close(replay)
                    now, replay, last = (d, s), start(s), None
                if last is not None and q < last:
                    raise RuntimeError(f"events of {s} are out of order: {q} after {last}")
                last = q
                if settled := replay.feed(ev):
                    rows += emit(replay, settled)
                if len(rows) >= STEP_ROWS:
                    yield batch_of(rows, d)
                    rows = []
        if replay is not None:
            rows += emit(replay, replay.finish())
            rows += close(replay)
        if rows:
            yield batch_of(rows, now[0])

    return run


def _arrow(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(k) if pa.types.is_timestamp(k) else pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


_PA = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us"), "boolean": pa.bool_()}


def _schema(text: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [x.split() for x in text.split(", ")]
    return [n for n, _ in pairs], [_PA[k] for _, k in pairs]


def replay_fills(orders: DataFrame, previous_close: dict[str, int] | None = None, lookahead: int = LOOKAHEAD, detail: bool = False, order_by: Column | str | None = None, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every trade the books generate; with ``detail`` also which order was incoming and whether hidden quantity traded.

    ``txn_time`` is that of the incoming order's event.  ``previous_close`` has one entry a symbol.
    """
    closes = previous_close or {}
    schema = FILL_SCHEMA + FILL_DETAIL * detail
    names, kinds = _schema(schema)

    def emit(replay: SymbolReplay, fills: list[Fill]) -> list[tuple]:
        s = replay.book.symbol
        rows = [(s, f.ts, f.price, f.quantity, f.buy_order, f.sell_order, "B" if f.aggressor == BUY else "S") for f in fills]
        return [(*r, f.incoming, f.resting, f.from_hidden) for r, f in zip(rows, fills)] if detail else rows

    run = _fold(lambda s: SymbolReplay(s, lookahead, closes.get(s)), emit, lambda r: [], lambda rows, d: _arrow(rows, names, kinds))
    return in_feed_order(extract_events(orders, order_by, key)).mapInArrow(run, schema)


def replay_snapshots(orders: DataFrame, interval_secs: float = DEFAULT_INTERVAL, levels: int = DEFAULT_LEVELS, previous_close: dict[str, int] | None = None, lookahead: int = LOOKAHEAD, order_by: Column | str | None = None, key: tuple[str, ...] = ("symbol",), tally: bool = False) -> DataFrame:
    """Book snapshots on clock boundaries, each the state before events at or after its time.

    With ``tally`` one more row per book and day, all null but for the columns of ``TALLY``, has its counters.
    """
    interval = interval_micros(interval_secs)
    if levels < 1:
        raise FeedError("levels must be at least 1")
    closes = previous_close or {}
    cols = snapshot_columns(levels) + [(n, k, True) for n, k in TALLY.items()] * tally
    names, kinds = [n for n, _, _ in cols], [_PA[k] for _, k, _ in cols]
    fills: dict[int, int] = {}
    blank = (None,) * len(TALLY) * tally

    def emit(replay: SymbolReplay, out: list) -> list[tuple]:
        shots = [x + blank for x in out if x.__class__ is tuple]
        if tally:
            fills[id(replay)] = fills.get(id(replay), 0) + len(out) - len(shots)
        return shots

    def close(replay: SymbolReplay) -> list[tuple]:
        b = replay.book
        end = (b.stats.events_applied, fills.pop(id(replay), 0), b.stats.replenishments, int(b.is_crossed()))
        return [(None,) * (len(cols) - len(TALLY)) + end] if tally else []

    run = _fold(lambda s: SymbolReplay(s, lookahead, closes.get(s), interval, levels), emit, close, lambda rows, d: _arrow(rows, names, kinds))
    return in_feed_order(extract_events(orders, order_by, key)).mapInArrow(run, ", ".join(f"{n} {k}" for n, k, _ in cols))


STATS_SCHEMA = "symbol string, " + ", ".join(f"{c} bigint" for c in COUNTERS) + ", fills bigint, snapshots bigint, closing_price bigint, live_orders bigint, resting_hidden bigint, pending_stops bigint, crossed boolean"


def replay_stats(orders: DataFrame, previous_close: dict[str, int] | None = None, lookahead: int = LOOKAHEAD, interval_secs: float | None = None, order_by: Column | str | None = None, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row of counters per day and symbol at the end of its session."""
    closes = previous_close or {}
    names, kinds = _schema(STATS_SCHEMA)
    interval = None if interval_secs is None else interval_micros(interval_secs)
    seen: dict[int, list[int]] = {}

    def emit(replay: SymbolReplay, out: list) -> list[tuple]:
        n = seen.setdefault(id(replay), [0, 0])
        for x in out:
            n[x.__class__ is tuple] += 1
        return []

    def close(replay: SymbolReplay) -> list[tuple]:
        b = replay.book
        fills, snapshots = seen.pop(id(replay), [0, 0])
        return [(b.symbol, *(getattr(b.stats, c) for c in COUNTERS), fills, snapshots, b.closing_price(), len(b.orders), b.resting_hidden, b.pending_stops(), b.is_crossed())]

    run = _fold(lambda s: SymbolReplay(s, lookahead, closes.get(s), interval, 1), emit, close, lambda rows, d: _arrow(rows, names, kinds))
    return in_feed_order(extract_events(orders, order_by, key)).mapInArrow(run, STATS_SCHEMA)


def interval_micros(seconds: float) -> int:
    if not seconds > 0:
        raise FeedError(f"the interval must be positive, not {seconds}")
    return round(seconds * 1_000_000)


FILE_ORDER = "_order"


def with_file_order(df: DataFrame) -> DataFrame:
    """Parsed orders with their place in the files as ``_order``; Parquet keeps rows in feed order."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias(FILE_ORDER))


def load_orders(spark: SparkSession, path: str, day: str | Date | None = None, where: str | None = "series == 'EQ'", symbols: list[str] | None = None, max_records: int | None = None) -> tuple[DataFrame, Column | str, str]:
    """(orders, order column, kind of source) from parsed Parquet or a raw order feed.

    The series filter applies to raw feeds only; a parsed table holds what was parsed, and securities with several series share a book.
    """
    if storage.is_dir(spark, path) or path.endswith(".parquet"):
        df = read_parsed(spark, path, symbols)
        require_columns(df)
        ordered = with_file_order(spark.read.parquet(path)) if "seq" not in df.columns else df
        if "seq" in df.columns:
            return df, "seq", "parquet"
        wide = {f.name: F.col(f.name).cast("bigint") for f in ordered.schema if f.dataType.simpleString() == "decimal(20,0)"}
        ordered = ordered.withColumns(wide | {"symbol": F.col("symbol").cast("string")})
        return (ordered.where(F.col("symbol").isin(symbols)) if symbols else ordered), FILE_ORDER, "parquet"
    feed = open_feed(spark, path, layout="cm_orders", day=day, where=where, select=[*REQUIRED, *OPTIONAL], max_records=max_records, with_seq=True)
    df = feed.df.where(F.col("symbol").isin(symbols)) if symbols else feed.df
    return df, "seq", "raw"


def build_books(
    spark: SparkSession,
    input: str,
    out: str,
    date: str | Date | None = None,
    where: str | None = "series == 'EQ'",
    interval_secs: float = DEFAULT_INTERVAL,
    levels: int = DEFAULT_LEVELS,
    compression: str = "snappy",
    max_records: int | None = None,
    symbols: list[str] | None = None,
    previous_close: dict[str, int] | None = None,
    threads: int | None = None,
) -> dict:
    """Replay a session and write its snapshots under ``segment=cm/kind=book_snapshots/date=/symbol=/``; returns the report."""
    began = time.time()
    codec = compression_of(compression)
    orders, by, source = load_orders(spark, input, date, where, symbols, max_records)
    day = parse_date(date) if date is not None else _day_of_path(input)
    read, done = Observation(), Observation()
    orders = orders.observe(read, F.count(F.lit(1)).alias("rows"))
    snaps = replay_snapshots(orders, interval_secs, levels, previous_close, order_by=by, tally=True)
    # One fold gives the snapshots, and the counters on the way
    sums = [F.sum(c).alias(c) for c in TALLY]
    snaps = snaps.observe(done, *sums, F.count("_events").alias("books"), F.count("symbol").alias("snapshots")).where("_events is null").drop(*TALLY)
    root = f"{out.rstrip('/')}/segment=cm/kind=book_snapshots/date={day}"
    snaps.write.mode("overwrite").option("compression", codec).partitionBy("symbol").parquet(root)
    total = {k: int(v or 0) for k, v in done.get.items()}
    return {
        "source": source,
        "rows_read": int(read.get["rows"] or 0),
        "events_applied": total["_events"],
        "symbols": total["books"],
        "snapshots": total["snapshots"],
        "fills_generated": total["_fills"],
        "replenishments": total["_replenishments"],
        "crossed_symbols": total["_crossed"],
        "elapsed_secs": time.time() - began,
        "threads": threads or spark.sparkContext.defaultParallelism,
        "bytes_decompressed": 0,
    }


def _day_of_path(path: str) -> Date:
    from tapeloom.sources.layouts import infer_date

    name = path.rstrip("/").rpartition("/")[2]
    if name.startswith("date="):
        text = name.removeprefix("date=")
        try:
            return Date.fromisoformat(text)
        except ValueError:
            found = infer_date(text)
    else:
        found = infer_date(path)
    if found is None:
        raise FeedError(f"no session date follows from {name!r}; give one")
    return found


def dump_fills(fills: DataFrame, path: str) -> None:
    """Fills as CSV without a header."""
    fills.write.mode("overwrite").option("header", False).csv(path)


DIVERGENCE_SCHEMA = "symbol string, ts timestamp_ntz, order_number bigint, side string, activity int, kind string, first_difference int, ours string, actual string"
KINDS = ("we_traded_exchange_did_not", "exchange_traded_we_did_not", "actual_resting_order_not_in_our_queue", "different_allocation")


def lockstep(events: list[Event], labelled: list[tuple], symbol: str = "", lookahead: int = LOOKAHEAD) -> Iterator[tuple]:
    """Events at which the rules trade otherwise than the exchange did.

    ``labelled``: (kind, event ts, aggressor, resting, price, quantity); kind C names continuous trades.  One book
    follows the exchange's trades, the other the rules; after each divergence the second starts again from the first.
    """
    from copy import deepcopy

    from tapeloom.operators.book import CONTINUOUS_FROM, OrderBook

    known: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for kind, ts, aggressor, resting, price, quantity in labelled:
        if kind == "C":
            known.setdefault((aggressor, ts), []).append((resting, price, quantity))
    truth, rules, read = OrderBook(symbol), None, 0
    for ev in events:
        while read < len(events) and events[read].ts <= ev.ts + lookahead:
            truth.announce(events[read])
            if rules is not None:
                rules.announce(events[read])
            read += 1
        if ev.session_clock() < CONTINUOUS_FROM:
            truth.apply(ev)
            continue
        if rules is None:
            truth.close_pre_open()
            rules = deepcopy(truth)
        actual = known.pop((ev.order, ev.ts), [])
        here = {o.order for p in {t[1] for t in actual} | set(truth.prices(1 - ev.side)[:3]) for o in truth.queue(1 - ev.side, p)}
        rules.apply(ev)
        ours = [(f.resting, f.price, f.quantity) for f in rules.fills]
        truth.force_next_match([(r, q) for r, _, q in actual])
        truth.apply(ev)
        if ours == actual:
            continue
        if not actual:
            kind = KINDS[0]
        elif not ours:
            kind = KINDS[1]
        else:
            kind = KINDS[3] if all(r in here for r, _, _ in actual) else KINDS[2]
        first = next((i for i, (a, b) in enumerate(zip(ours, actual)) if a != b), min(len(ours), len(actual)))
        yield (symbol, ev.ts, ev.order, "BS"[ev.side], ev.activity, kind, first, str(ours), str(actual))
        rules = deepcopy(truth)


def diverging_events(orders: DataFrame, labels: DataFrame, order_by: Column | str | None = None) -> DataFrame:
    """``lockstep`` for every day and symbol: ``labels`` has (symbol, kind, event_ts, aggressor, resting, price, quantity, trade_number).

    A ``session_time`` must keep the date of ``txn_time`` here.
    """
    import pandas as pd

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("seq"), right.sort_values("trade_number")
        events = [Event._make(r) for r in left[list(EVENT_COLUMNS)].itertuples(index=False, name=None)]
        rows = right[["kind", "event_ts", "aggressor", "resting", "price", "quantity"]].itertuples(index=False, name=None)
        out = pd.DataFrame(list(lockstep(events, [r for r in rows], key[1])), columns=[x.split()[0] for x in DIVERGENCE_SCHEMA.split(", ")])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        return out

    events = extract_events(orders, order_by).groupBy("day", "symbol")
    day = timestamp_of_micros(F.col("event_ts")).cast("date")
    known = labels.where("kind = 'C'").withColumn("day", day).groupBy("day", "symbol")
    return events.cogroup(known).applyInPandas(run, DIVERGENCE_SCHEMA)


def read_labels_csv(path: str) -> list[tuple]:
    """Labelled trades of one security as ``lockstep`` takes them."""
    with open(path, newline="") as f:
        return [(r[0], *(int(x) if x else 0 for x in r[1:6])) for r in csv.reader(f) if r]
