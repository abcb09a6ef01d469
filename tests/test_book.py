"""Hand-worked books, one rule each.  Prices in paise, times from ten o'clock."""

import random

import pytest

from tapeloom.operators.book import BUY, CANCEL, ENTRY, MODIFY, SELL, Event, OrderBook, SymbolReplay, auction_prices, clock, first_boundary, snapshot_columns

T0 = 18_000 * 86_400_000_000 + clock(10, 0)
DAY0 = 18_000 * 86_400_000_000
SIDES = {"B": BUY, "S": SELL}


class Desk:
    """A book and a clock that moves on a second an event unless told otherwise."""

    def __init__(self, start=T0, **kw):
        self.book, self.now = OrderBook("X", **kw), start

    def send(self, activity, order, side, price, quantity, disclosed=0, at=None, **kw):
        self.now = self.now + 1_000_000 if at is None else at
        ev = Event(self.now, order, activity, SIDES[side], price, quantity, disclosed, **kw)
        self.book.apply(ev)
        return [(f.resting, f.quantity) for f in self.book.fills]

    def enter(self, order, side, price, quantity, disclosed=0, **kw):
        return self.send(ENTRY, order, side, price, quantity, disclosed, **kw)

    def modify(self, order, side, price, quantity, disclosed=0, **kw):
        return self.send(MODIFY, order, side, price, quantity, disclosed, **kw)

    def cancel(self, order, side="B", **kw):
        return self.send(CANCEL, order, side, 0, 0, **kw)

    def top(self, side):
        got = self.book.top_levels(SIDES[side], 1)
        return got[0] if got else None

    @property
    def stats(self):
        return self.book.stats


@pytest.fixture
def desk():
    return Desk()


def test_market_order_sweeps_and_never_rests(desk):
    desk.enter(1, "S", 10000, 10)
    desk.enter(2, "S", 10005, 10)
    assert desk.enter(3, "B", 0, 25, market=True) == [(1, 10), (2, 10)]
    assert [f.price for f in desk.book.fills] == [10000, 10005]
    assert desk.stats.unrested_quantity == 5 and not desk.book.orders


def test_market_sell_takes_the_bid(desk):
    desk.enter(1, "B", 9995, 10)
    assert desk.enter(2, "S", 0, 4, market=True) == [(1, 4)]
    assert desk.book.fills[0].price == 9995 and desk.book.best_bid() == 9995


def test_ioc_remainder_is_discarded_and_its_cancel_known(desk):
    desk.enter(1, "S", 10000, 10)
    assert desk.enter(2, "B", 10000, 30, ioc=True) == [(1, 10)]
    assert desk.book.best_bid() is None
    desk.cancel(2)
    assert desk.stats.remainder_cancels == 1 and desk.stats.unknown_order_refs == 0


def test_stop_waits_for_its_second_record(desk):
    desk.enter(1, "S", 10100, 10)
    assert desk.enter(2, "B", 10100, 10, stop=True, trigger=10050) == [] and desk.book.pending_stops() == 1
    desk.enter(3, "S", 10060, 1)
    desk.enter(4, "B", 10060, 1)
    assert desk.book.pending_stops() == 1
    assert desk.enter(2, "B", 10100, 10, stop=True, trigger=10050) == [(1, 10)]
    assert desk.book.best_ask() is None and desk.stats.stops_triggered == 1


def test_stop_converted_rearmed_cancelled(desk):
    desk.enter(1, "S", 10100, 10)
    desk.enter(2, "B", 10100, 4, stop=True, trigger=10050)
    assert desk.modify(2, "B", 10100, 4) == [(1, 4)]
    desk.enter(3, "B", 9000, 5)
    desk.modify(3, "B", 9000, 5, stop=True, trigger=9500)
    assert desk.book.best_bid() is None and desk.book.pending_stops() == 1
    desk.cancel(3)
    assert desk.book.pending_stops() == 0 and desk.stats.unknown_order_refs == 0


def stp_book():
    d = Desk()
    d.enter(1, "S", 10000, 5, at=T0 + 1000)
    d.enter(2, "S", 10000, 5, at=T0 + 1500)
    return d


def test_self_trade_prevention_withdraws_the_resting_order():
    d = stp_book()
    d.book.announce(Event(T0 + 5015, 1, CANCEL, SELL, 10000, 5))
    assert d.enter(9, "B", 10000, 5, at=T0 + 5000) == [(2, 5)]
    assert d.stats.self_trade_preventions == 1
    d.cancel(1, "S", at=T0 + 5015)
    assert d.stats.unknown_order_refs == 0


def test_a_late_own_cancel_does_not_prevent_the_trade():
    d = stp_book()
    d.book.announce(Event(T0 + 5336, 1, CANCEL, SELL, 10000, 5))
    assert d.enter(9, "B", 10000, 5, at=T0 + 5000) == [(1, 5)]


def test_self_trade_prevention_withdraws_the_incoming_order():
    d = stp_book()
    d.book.announce(Event(T0 + 5015, 9, CANCEL, BUY, 10000, 5))
    assert d.enter(9, "B", 10000, 5, at=T0 + 5000) == []
    assert d.book.best_bid() is None and d.top("S") == (10000, 10, 0)


def test_prevention_splits_the_trade_record():
    d = Desk()
    d.enter(1, "S", 10000, 20, 5, at=T0 + 1000)
    d.enter(2, "S", 10000, 5, at=T0 + 1500)
    d.book.announce(Event(T0 + 5030, 2, CANCEL, SELL, 10000, 5))
    assert d.enter(9, "B", 10000, 7, at=T0 + 5000) == [(1, 5), (1, 2)]
    assert d.top("S") == (10000, 3, 10)


def test_an_order_without_price_or_market_flag_is_rejected(desk):
    desk.enter(1, "B", 0, 10)
    desk.enter(2, "B", 10000, 0)
    desk.send(7, 3, "B", 10000, 1)
    assert desk.stats.events_rejected == 3


def test_touch_composition(desk):
    desk.enter(1, "B", 10000, 30, algo=0, client=2)
    desk.enter(2, "B", 10000, 20, algo=1, client=1)
    t = desk.book.touch(BUY)
    assert (t.algo_qty, t.custodian_qty, t.orders) == (30, 20, 2)


def test_basics(desk):
    desk.enter(1, "B", 9990, 10)
    desk.enter(2, "S", 10010, 10)
    assert (desk.book.best_bid(), desk.book.best_ask(), desk.book.spread(), desk.book.mid_price()) == (9990, 10010, 20, 10000.0)
    desk.enter(3, "S", 10010, 5)
    assert desk.enter(4, "B", 10010, 12) == [(2, 10), (3, 2)]
    assert desk.top("S") == (10010, 3, 0)
    assert desk.enter(5, "B", 10020, 10) == [(3, 3)]
    assert desk.top("B") == (10020, 7, 0) and not desk.book.is_crossed()


def test_iceberg_display_and_replenishment(desk):
    desk.enter(1, "S", 10000, 1000, 100)
    assert desk.top("S") == (10000, 100, 900) and desk.book.resting_hidden == 900
    desk.enter(2, "B", 10000, 100)
    assert desk.stats.replenishments == 1 and desk.top("S") == (10000, 100, 800)
    desk.cancel(1, "S")
    assert desk.book.resting_hidden == desk.book.active_icebergs == 0 and desk.book.best_ask() is None


def test_a_new_tranche_goes_to_the_back(desk):
    desk.enter(1, "S", 10000, 100, 10)
    desk.enter(2, "S", 10000, 10)
    assert desk.enter(3, "B", 10000, 10) == [(1, 10)]
    assert desk.enter(4, "B", 10000, 10) == [(2, 10)]


def test_a_sweep_across_tranches_is_one_record(desk):
    desk.enter(1, "S", 10000, 500, 100)
    assert desk.enter(2, "B", 10000, 500) == [(1, 500)] and desk.book.fills[0].from_hidden


def test_from_hidden_starts_with_the_second_tranche(desk):
    desk.enter(1, "S", 10000, 100, 10)
    desk.enter(2, "B", 10000, 10)
    assert not desk.book.fills[0].from_hidden
    desk.enter(3, "B", 10000, 10)
    assert desk.book.fills[0].from_hidden


def test_modifies(desk):
    for i in (1, 2, 3):
        desk.enter(i, "S", 10000, 5)
    desk.modify(2, "S", 9999, 5)
    desk.modify(2, "S", 10000, 5)
    assert desk.enter(9, "B", 10000, 15) == [(1, 5), (3, 5), (2, 5)]


def test_quantity_up_loses_place_down_keeps_it(desk):
    desk.enter(1, "S", 10000, 5)
    desk.enter(2, "S", 10000, 5)
    desk.modify(1, "S", 10000, 4)
    assert desk.stats.amended_in_place == 1
    assert desk.enter(8, "B", 10000, 6) == [(1, 4), (2, 2)]
    desk.enter(3, "S", 10000, 5)
    desk.modify(2, "S", 10000, 9)
    assert desk.enter(9, "B", 10000, 6) == [(3, 5), (2, 1)]


def test_depth_in_a_band(desk):
    desk.enter(1, "B", 9990, 10)
    desk.enter(2, "B", 9000, 10)
    desk.enter(3, "S", 10010, 10)
    desk.enter(4, "S", 11000, 10)
    assert desk.book.depth_within_bps(200) == (10, 10)
    assert desk.book.prices(BUY) == [9990, 9000] and desk.book.prices(SELL) == [10010, 11000]


def test_many_cancels_leave_one_matchable_order(desk):
    for i in range(2, 50_002):
        desk.book.apply(Event(T0, i, ENTRY, SELL, 10000, 1))
    desk.book.apply(Event(T0, 99_999, ENTRY, SELL, 10000, 1))
    for i in range(2, 50_002):
        desk.book.apply(Event(T0, i, CANCEL, SELL, 10000, 1))
    assert desk.enter(100_000, "B", 10000, 1) == [(99_999, 1)]


def test_a_trade_that_runs_on_shows_a_fresh_tranche(desk):
    desk.enter(1, "S", 10000, 100, 10)
    assert desk.enter(2, "B", 10000, 15) == [(1, 15)]
    assert desk.top("S") == (10000, 10, 75)


def test_own_trades_wear_the_tranche_down(desk):
    desk.enter(1, "S", 10000, 3)
    desk.enter(2, "B", 10000, 50, 10)
    assert desk.top("B") == (10000, 7, 40)


def test_a_modify_keeps_or_refreshes_the_tranche(desk):
    desk.enter(1, "S", 10000, 100, 10)
    desk.enter(2, "B", 10000, 4)
    desk.modify(1, "S", 10010, 96, 10)
    assert desk.top("S") == (10010, 6, 90)
    desk.modify(1, "S", 10010, 96, 20)
    assert desk.top("S") == (10010, 20, 76)


@pytest.mark.parametrize(("disclosed", "first"), [(5, 1), (20, 2)])
def test_priority_after_a_change_of_display(disclosed, first):
    d = Desk()
    d.enter(1, "S", 10000, 100, 10)
    d.enter(2, "S", 10000, 10)
    d.modify(1, "S", 10000, 100, disclosed)
    assert d.enter(3, "B", 10000, 1) == [(first, 1)]


def test_post_close_session():
    d = Desk(DAY0 + clock(15, 10))
    for i, (p, q) in enumerate([(10000, 13), (10010, 7)]):
        d.enter(10 + 2 * i, "S", p, q)
        d.enter(11 + 2 * i, "B", p, q)
    assert d.book.closing_price() == 10005  # 10003.5 cut to 10003, then to the nearest step
    d.enter(1, "B", 9000, 5)
    d.enter(5, "S", 0, 6, market=True, at=DAY0 + clock(15, 41))
    assert d.book.best_bid() is None and d.book.best_ask() == 10005
    d.cancel(1, at=DAY0 + clock(15, 42))
    assert d.stats.unknown_order_refs == 0
    assert d.enter(6, "B", 10005, 2, at=DAY0 + clock(15, 43)) == [(5, 2)] and d.book.fills[0].price == 10005


def test_no_switch_without_any_trade():
    d = Desk(DAY0 + clock(15, 20))
    d.enter(1, "B", 9000, 5)
    d.enter(2, "S", 9500, 5, at=DAY0 + clock(15, 40))
    assert d.book.best_bid() == 9000



def auction_desk(**kw):
    d = Desk(DAY0 + clock(9, 0), **kw)
    d.enter(1, "B", 10000, 10)
    d.enter(2, "B", 10000, 5)
    d.enter(3, "S", 9900, 8)
    d.enter(4, "S", 10000, 10)
    d.enter(5, "B", 0, 3, market=True)
    d.enter(6, "B", 9800, 4)
    return d


def test_call_auction_pairs_limits_then_market_orders():
    d = auction_desk()
    d.book.close_pre_open()
    got = [(f.buy_order, f.sell_order, f.quantity, f.price) for f in d.book.fills]
    assert got == [(1, 3, 8, 10000), (1, 4, 2, 10000), (2, 4, 5, 10000), (5, 4, 3, 10000)]
    assert d.book.best_bid() == 9800 and d.book.best_ask() is None


def test_auction_runs_with_the_first_event_after_it():
    d = auction_desk()
    assert d.enter(7, "S", 9800, 4, at=DAY0 + clock(9, 9)) and d.book.best_ask() == 9800 and d.book.is_crossed()
    assert [f.ts for f in d.book.fills] == [DAY0 + clock(9, 0) + 6_000_000] * 4


def test_nothing_matches_between_auction_and_open():
    d = Desk(DAY0 + clock(9, 10))
    d.enter(1, "S", 10000, 5)
    assert d.enter(2, "B", 10000, 5) == [] and d.book.is_crossed()
    assert d.enter(3, "B", 0, 5, market=True) == [] and d.stats.unrested_quantity == 5


def test_pre_open_modify_keeps_time_unless_it_grows():
    d = Desk(DAY0 + clock(9, 0))
    d.enter(1, "B", 10000, 10)
    d.enter(2, "B", 10000, 10)
    d.modify(1, "B", 10000, 6)
    d.enter(3, "S", 10000, 5)
    d.book.close_pre_open()
    assert [f.buy_order for f in d.book.fills] == [1]


def test_auction_tie_takes_the_previous_close_or_the_lowest():
    for close, want in ((None, 9900), (10100, 10000), (9950, 9900)):
        d = Desk(DAY0 + clock(9, 0), previous_close=close)
        d.enter(1, "B", 10000, 10)
        d.enter(2, "S", 9900, 10)
        d.book.close_pre_open()
        assert d.book.fills[0].price == want


def test_conversion_of_a_market_order_runs_the_auction_at_its_price():
    d = Desk(DAY0 + clock(9, 0))
    d.enter(1, "B", 0, 10, market=True)
    d.enter(2, "S", 9900, 6)
    fills = d.modify(1, "B", 9900, 4, at=DAY0 + clock(9, 7) + 30_000_000)
    assert fills[:1] == [(2, 6)] and d.book.best_bid() == 9900 and d.stats.unknown_order_refs == 0
    e = Desk(DAY0 + clock(9, 0))
    e.enter(1, "B", 0, 10, market=True)
    e.enter(2, "S", 9900, 6)
    assert e.modify(1, "B", 9900, 5, at=DAY0 + clock(9, 7) + 30_000_000) == []  # not the leftover: an ordinary modify


def test_market_only_auction_has_no_price():
    d = Desk(DAY0 + clock(9, 0))
    d.enter(1, "B", 0, 10, market=True)
    d.enter(2, "S", 0, 10, market=True)
    assert d.book.close_pre_open() == 0 and not d.book.orders


def test_auction_prices_against_the_definition():
    r = random.Random(1)
    from tapeloom.operators.book import Waiting

    for _ in range(200):
        os = [Waiting(i, r.randrange(2), r.choice([0, 95, 100, 105, 110]), r.randint(1, 9), 0, r.random() < 0.2, i, 1, 1) for i in range(r.randint(1, 12))]
        best = []
        for p in sorted({o.price for o in os if not o.market and o.price > 0}):
            d = sum(o.quantity for o in os if o.side == BUY and (o.market or o.price >= p))
            s = sum(o.quantity for o in os if o.side == SELL and (o.market or o.price <= p))
            if min(d, s) > 0:
                best.append((-min(d, s), abs(d - s), p))
        want = [p for v, i, p in best if (v, i) == min((v, i) for v, i, _ in best)]
        assert auction_prices(os) == want


def test_forced_matches(desk):
    desk.enter(1, "S", 10000, 50, 10)
    desk.enter(2, "S", 10000, 5)
    desk.book.force_next_match([(2, 3), (1, 25), (7, 4), (2, 9)])
    assert desk.enter(9, "B", 10000, 40) == [(2, 3), (1, 25), (2, 2)]
    assert desk.book.forced_misses() == (1, 4 + 7)
    desk.enter(3, "B", 9000, 6)
    assert desk.book.force_cross(3, 1, 4, T0) == (4, 4)


def drive(lookahead):
    rep = SymbolReplay("X", lookahead)
    evs = [Event(T0, 1, ENTRY, SELL, 10000, 5), Event(T0 + 5000, 2, ENTRY, BUY, 10000, 5), Event(T0 + 5015, 1, CANCEL, SELL, 10000, 5)]
    out = [f for e in evs for f in rep.feed(e)] + list(rep.finish())
    return len(out), rep.book.stats.self_trade_preventions


def test_lookahead():
    assert drive(100_000) == (0, 1)
    assert drive(0) == (1, 0)


def test_snapshots_fall_on_the_clock():
    rep = SymbolReplay("X", 0, interval=1_000_000, levels=2)
    rows = []
    for ts, order in ((T0 + 1_230_000, 1), (T0 + 3_500_000, 2)):
        rows += [x for x in rep.feed(Event(ts, order, ENTRY, BUY, 9000 + order, 10, 4)) if isinstance(x, tuple)]
    rows += [x for x in rep.finish() if isinstance(x, tuple)]
    names = [n for n, _, _ in snapshot_columns(2)]
    got = [dict(zip(names, r)) for r in rows]
    assert [g["snapshot_time"] for g in got] == [T0 + 2_000_000, T0 + 3_000_000]
    assert got[0]["bid_px_1"] == 9001 and got[0]["bid_qty_1"] == 4 and got[0]["bid_hidden_1"] == 6 and got[0]["bid_px_2"] is None
    assert got[0]["best_ask"] is None and got[0]["mid_price"] is None and got[0]["is_crossed"] == "N"
    assert [g["interval_entries"] for g in got] == [1, 0]
    assert len(names) == 29 + 6 * 2 and first_boundary(T0, 1_000_000) == T0 + 1_000_000


def test_worked_example(desk):
    """Four resting orders, one of them disclosed in part, one withdrawn by prevention; a buy of 500."""
    desk.enter(1, "S", 10000, 100, at=T0)
    desk.enter(2, "S", 10000, 300, 100, at=T0 + 1)
    desk.enter(3, "S", 10000, 100, at=T0 + 2)
    desk.enter(4, "S", 10005, 400, at=T0 + 3)
    desk.book.announce(Event(T0 + 5000 + 46, 3, CANCEL, SELL, 10000, 100))
    fills = desk.enter(9, "B", 10005, 500, at=T0 + 5000)
    assert fills == [(1, 100), (2, 100), (2, 200), (4, 100)]


def test_random_books_conserve_quantity():
    r = random.Random(5)
    for _ in range(30):
        d, live, n = Desk(), [], 0
        for _ in range(300):
            x = r.random()
            side = r.choice("BS")
            if x < 0.6 or not live:
                n += 1
                q = r.randint(1, 60)
                live.append((n, side))
                d.enter(n, side, 10000 + 5 * r.randint(-6, 6), q, r.choice([0, 0, 1 + q // 4]), ioc=r.random() < 0.1, market=r.random() < 0.05)
            elif x < 0.8:
                d.cancel(*live.pop(r.randrange(len(live))))
            else:
                o, s = r.choice(live)
                q = r.randint(1, 60)
                d.modify(o, s, 10000 + 5 * r.randint(-6, 6), q, r.choice([0, 1 + q // 3]))
            book = d.book
            assert not book.is_crossed() or not (book.top_levels(BUY, 1) and book.top_levels(SELL, 1)) or d.top("B")[0] < d.top("S")[0]
            for side, ladder in enumerate(book.sides):
                mine = [o for o in book.orders.values() if o.side == side]
                for p, level in ladder.levels.items():
                    assert level.shown == sum(o.shown for o in mine if o.price == p)
                    assert level.hidden == sum(o.hidden for o in mine if o.price == p)
                assert sorted(ladder.levels) == ladder.prices
            assert book.resting_hidden == sum(o.hidden for o in book.orders.values())
            assert book.active_icebergs == sum(o.hidden > 0 for o in book.orders.values())
            assert all(0 < o.left and 0 <= o.shown <= o.left for o in book.orders.values())
