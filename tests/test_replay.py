"""The Spark fold against the plain book, native auction against the fold, verification, labels, streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom import api
from tapeloom.errors import FeedError
from tapeloom.operators import auction, features, labels, replay, verify
from tapeloom.operators.book import BUY, CANCEL, ENTRY, MODIFY, SELL, Event, SymbolReplay, snapshot_columns

OPEN = datetime(2022, 1, 27, 9, 15)
SCHEMA = "seq long, symbol string, txn_time timestamp_ntz, order_number long, activity_type short, buy_sell string, limit_price long, volume_original long, volume_disclosed long, algo_indicator short, client_identity short, ioc_flag boolean, mkt_order_flag boolean, stop_loss_flag boolean, trigger_price long"


def random_orders(seed, n=600, symbols=("AAA", "BBB", "20"), start=OPEN, step=20_000):
    r = random.Random(seed)
    out, live = [], []
    for i in range(n):
        s = r.choice(symbols)
        side = r.choice("BS")
        number, act = i + 1, ENTRY
        if live and r.random() < 0.35:
            number, s, side = r.choice(live)
            act = r.choice([CANCEL, MODIFY])
        else:
            live.append((number, s, side))
        q = r.randint(1, 80)
        market = r.random() < 0.05
        out.append((i, s, start + timedelta(microseconds=i * step), number, act, side, 0 if market else 10000 + 5 * r.randint(-8, 8), q, r.choice([0, 0, 1 + q // 4]), r.randrange(4), r.randint(1, 3), r.random() < 0.1, market, r.random() < 0.03, 9990))
    return out


def plain(rows, **kw):
    out = {}
    for s in sorted({r[1] for r in rows}):
        rep = SymbolReplay(s, **kw)
        got = []
        for r in rows:
            if r[1] == s:
                ts = int((r[2] - datetime(1970, 1, 1)) / timedelta(microseconds=1))
                got += list(rep.feed(Event(ts, r[3], r[4], BUY if r[5] == "B" else SELL, r[6], r[7], r[8], r[9], r[10], r[11], r[12], r[13], r[14])))
        out[s] = got + list(rep.finish()), rep
    return out


def micros(t):
    return int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))


@pytest.mark.parametrize("step", [15, 20_000])
def test_fold_equals_the_plain_book(spark, step):
    rows = random_orders(1, step=step)
    want = plain(rows)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = replay.replay_fills(df, detail=True).collect()
        for s, (fills, _) in want.items():
            mine = [(micros(r.txn_time), r.trade_price, r.trade_quantity, r.incoming_order, r.resting_order, r.from_hidden) for r in got if r.symbol == s]
            assert mine == [(f.ts, f.price, f.quantity, f.incoming, f.resting, f.from_hidden) for f in fills]
    stats = {r.symbol: r for r in replay.replay_stats(df).collect()}
    for s, (fills, rep) in want.items():
        assert {c: stats[s][c] for c in rep.book.stats.as_dict()} == rep.book.stats.as_dict() and stats[s].fills == len(fills)
        assert (stats[s].live_orders, stats[s].closing_price) == (len(rep.book.orders), rep.book.closing_price())


def test_snapshots_equal_the_plain_book(spark):
    rows = random_orders(2)
    want = [x for fills, _ in plain(rows, interval=500_000, levels=3).values() for x in fills if isinstance(x, tuple)]
    got = replay.replay_snapshots(spark.createDataFrame(rows, SCHEMA), 0.5, 3)
    names = [n for n, _, _ in snapshot_columns(3)]
    assert got.columns == names
    assert sorted((r.symbol, micros(r.snapshot_time), *r[2:]) for r in got.collect()) == sorted(want) and want
    for bad in ({"levels": 0}, {"interval_secs": 0}, {"interval_secs": float("nan")}):
        with pytest.raises(FeedError):
            replay.replay_snapshots(got, **bad)


def test_rows_that_cannot_be_applied_are_left_out(spark):
    rows = random_orders(3, 30)
    bad = [(100, None, *rows[0][2:]), (101, "AAA", None, *rows[0][3:]), (102, "AAA", OPEN, None, *rows[0][4:]), (103, "AAA", OPEN, 1, 1, "X", *rows[0][6:])]
    a = replay.replay_stats(spark.createDataFrame(rows, SCHEMA)).collect()
    b = replay.replay_stats(spark.createDataFrame(rows + bad, SCHEMA)).collect()
    assert sorted(a) == sorted(b)
    slim = spark.createDataFrame(rows, SCHEMA).drop("ioc_flag", "mkt_order_flag", "stop_loss_flag", "trigger_price")
    assert replay.replay_fills(slim).count() >= 0
    with pytest.raises(FeedError, match="missing"):
        replay.replay_fills(slim.drop("symbol"))


def test_native_auction_equals_the_fold(spark):
    for seed in range(4):
        rows = [r for r in random_orders(seed, 200, start=datetime(2022, 1, 27, 9, 0), step=1000) if r[4] == ENTRY]
        rows.append((10_000, "AAA", datetime(2022, 1, 27, 9, 9), 10_000, CANCEL, "B", 0, 0, 0, 1, 1, False, False, False, 0))
        rows += [(10_001 + i, s, datetime(2022, 1, 27, 9, 9), 10_001 + i, CANCEL, "B", 0, 0, 0, 1, 1, False, False, False, 0) for i, s in enumerate(("BBB", "20"))]
        df = spark.createDataFrame(rows, SCHEMA)
        fold = sorted((r.symbol, r.buy_order_number, r.sell_order_number, r.trade_price, r.trade_quantity) for r in replay.replay_fills(df).collect())
        orders = df.where("activity_type = 1").select("symbol", "order_number", F.col("buy_sell").alias("side"), F.col("limit_price").alias("price"), F.col("volume_original").alias("quantity"), F.col("mkt_order_flag").alias("market"), F.col("txn_time").alias("priority"))
        assert sorted(tuple(r) for r in auction.auction_trades(orders).collect()) == fold and fold
        left = {r.order_number: r.remaining for r in auction.auction_leftovers(orders).collect()}
        total = orders.agg(F.sum("quantity")).first()[0]
        assert sum(left.values()) + 2 * sum(t[4] for t in fold) == total


def test_worked_auction(spark):
    rows = [("X", 1, "B", 10000, 10, False, 1), ("X", 2, "B", 10000, 5, False, 2), ("X", 3, "S", 9900, 8, False, 3), ("X", 4, "S", 10000, 10, False, 4), ("X", 5, "B", 0, 3, True, 5), ("X", 6, "B", 9800, 4, False, 6), ("Y", 1, "B", 100, 5, False, 1)]
    orders = spark.createDataFrame(rows, "symbol string, order_number long, side string, price long, quantity long, market boolean, priority long")
    got = sorted(tuple(r)[1:] for r in auction.auction_trades(orders).collect())
    assert got == [(1, 3, 8, 10000)[:2] + (10000, 8), (1, 4, 10000, 2), (2, 4, 10000, 5), (5, 4, 10000, 3)]
    assert auction.auction_price(orders).collect()[0].price == 10000


def test_verify_and_missed(spark):
    cols = "symbol string, txn_time timestamp_ntz, buy_order_number long, sell_order_number long, trade_price long, trade_quantity long"
    t = datetime(2022, 1, 27, 10)
    actual = [("A", t, 1, 2, 100, 5), ("A", t, 1, 2, 100, 5), ("A", t, 3, 4, 101, 7), ("B", t, 1, 2, 50, 1), ("A", datetime(2022, 1, 27, 9, 8), 9, 8, 100, 1)]
    ours = [("A", t, 1, 2, 100, 5), ("A", t, 3, 4, 101, 3), ("A", t, 3, 4, 101, 4), ("C", t, 1, 1, 1, 1)]
    a, r = spark.createDataFrame(actual, cols), spark.createDataFrame(ours, cols)
    rows = {x.symbol: tuple(x)[1:] for x in verify.verify(a, r, continuous_only=True).collect()}
    assert rows == {"A": (3, 1, 2, 1, 4, 2, 17, 12), "B": (1, 0, 1, 0, 2, 0, 1, 0)}
    total = verify.with_totals(verify.verify(a, r)).where("symbol = 'ALL'").first()
    assert total.trades == 5 and total.volume == 19
    assert {(x.symbol, x.buy_order_number) for x in verify.missed(a, r).collect()} == {("A", 3), ("B", 1), ("A", 9)}
    assert len(verify.report_lines("d", verify.verify(a, r).collect())) == 3


def test_labels(spark, tmp_path):
    rows = random_orders(7, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    fills = replay.replay_fills(df, lookahead=0, detail=True).withColumn("trade_number", F.monotonically_increasing_id())
    got = labels.label_trades(fills, df).join(fills.select("symbol", "trade_number", "incoming_order", "resting_order"), ["symbol", "trade_number"])
    rows = got.collect()
    assert rows and all(r.kind == "C" and (r.aggressor, r.resting) == (r.incoming_order, r.resting_order) for r in rows)
    labels.write_labels(labels.label_trades(fills, df), str(tmp_path / "l"))
    # the exchange traded as we do: in lockstep there is nothing to report
    assert replay.diverging_events(df, labels.label_trades(fills, df)).count() == 0
    lost = labels.label_trades(fills, df).where("trade_number % 5 > 0")
    kinds = {r.kind for r in replay.diverging_events(df, lost).collect()}
    assert kinds and kinds <= set(replay.KINDS)


def test_features(spark):
    rows = [(i, "A", "B" if i % 2 else "S", i) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, symbol string, buy_sell string, v long")
    out = {r.seq: r for r in features.flow_features(df, ["symbol"], ["seq"], "v").collect()}
    assert out[98].rolling_mean is None and out[99].rolling_mean == 49.5 and out[0].difference is None and out[5].difference == 1
    assert out[3].ofi == -0 + 1 - 2 + 3


def test_unchanged_touch(spark):
    snaps = spark.createDataFrame([("A", i, b, 5) for i, b in enumerate([1, 1, 2, 2, 2])], "symbol string, snapshot_time long, best_bid long, best_ask long")
    r = features.unchanged_touch(snaps).first()
    assert (r.snapshots, r.unchanged) == (5, 0.75)


def test_books_from_raw_and_parsed_agree(spark, tmp_path):
    from tests.test_feed import order, write

    ticks = 87014847291575 + 900 * 65536
    recs = []
    for r in random_orders(9, 300, symbols=("AAA", "BBB")):
        recs.append(order(r[1], number=r[3], txn_time=f"{ticks + r[0] * 900:014d}", activity_type=r[4], buy_sell=r[5], price=r[6], volume=r[7], volume_disclosed=r[8], algo_indicator=r[9], client_identity=r[10], ioc_flag="NY"[r[11]], mkt_order_flag="NY"[r[12]]))
    path = write(tmp_path, recs)
    api.parse(spark, path, str(tmp_path / "parsed"))
    parsed = str(tmp_path / "parsed/segment=cm/kind=orders/date=2022-01-27")
    a = sorted(api.replay_fills(spark, path).collect())
    b = sorted(api.replay_fills(spark, parsed).collect())
    assert a == b and a
    assert {r.symbol for r in api.replay_fills(spark, parsed, symbols=["BBB"]).collect()} == {"BBB"}
    x = api.build_books(spark, path, str(tmp_path / "b1"), interval_secs=0.5, levels=5)
    y = api.build_books(spark, parsed, str(tmp_path / "b2"), interval_secs=0.5, levels=5)
    for k in ("events_applied", "symbols", "snapshots", "fills_generated", "replenishments", "rows_read"):
        assert x[k] == y[k], k
    assert (x["source"], y["source"]) == ("raw", "parquet") and x["snapshots"] > 0
    out = lambda p: sorted(map(str, spark.read.parquet(f"{tmp_path}/{p}/segment=cm/kind=book_snapshots").collect()))
    assert out("b1") == out("b2") and len(out("b1")) == x["snapshots"]


def test_stream_equals_batch(spark, tmp_path):
    from tapeloom.streaming.books import stream_fills

    rows = random_orders(11, 200)
    src = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    batch = sorted(tuple(r) for r in replay.replay_fills(spark.createDataFrame(rows, SCHEMA), lookahead=0).collect())
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))
    q = stream_fills(stream, lookahead=0).writeStream.format("memory").queryName("fills_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("fills_out").collect()) == batch


def test_sessions_are_kept_apart(spark):
    """Two days of one security: two auctions, closing prices, comparisons and books."""
    rows = [(d, "X", k, s, p, q, False, k) for d, p in (("2022-01-27", 100), ("2022-01-28", 200)) for k, s, q in ((1, "B", 5), (2, "S", 5))]
    orders = spark.createDataFrame(rows, "day string, symbol string, order_number long, side string, price long, quantity long, market boolean, priority long")
    by = ("day", "symbol")
    assert sorted((r.day, r.price) for r in auction.auction_price(orders, by=by).collect()) == [("2022-01-27", 100), ("2022-01-28", 200)]
    assert auction.auction_trades(orders, by=by).count() == 2 and auction.auction_leftovers(orders, by=by).count() == 0
    cols = "day string, symbol string, txn_time timestamp_ntz, buy_order_number long, sell_order_number long, trade_price long, trade_quantity long, seq long"
    fills = spark.createDataFrame([(str(t.date()), "X", t, 1, 2, p, 5, 1) for t, p in ((datetime(2022, 1, 27, 15, 10), 100), (datetime(2022, 1, 28, 15, 10), 200))], cols)
    assert sorted(r.closing_price for r in auction.closing_price(fills, by).collect()) == [100, 200]
    moved = fills.withColumn("day", F.lit("2022-01-27"))
    assert [(r.day, r.trades, r.exact) for r in verify.verify(fills, moved, by=by).collect()] == [("2022-01-27", 1, 1), ("2022-01-28", 1, 0)]
    day = random_orders(13, 80, symbols=("AAA",))
    next_day = [(r[0] + 1000, r[1], r[2] + timedelta(days=1), *r[3:]) for r in day]
    one, both = (spark.createDataFrame(x, SCHEMA) for x in (day, day + next_day))
    a, b = replay.replay_fills(one, lookahead=0).collect(), replay.replay_fills(both, lookahead=0).collect()
    assert len(b) == 2 * len(a) > 0
    numbered = replay.replay_fills(both, lookahead=0).withColumn("trade_number", F.monotonically_increasing_id())
    assert replay.diverging_events(both, labels.label_trades(numbered, both)).count() == 0
