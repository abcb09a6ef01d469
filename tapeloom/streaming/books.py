"""Order books over a stream of parsed order messages.

The fold is the one of the batch replay; its state is kept per symbol and day
by ``applyInPandasWithState``.  Within a micro-batch messages are sorted by ``seq``; across
batches they must come in feed order, as a feed does.  The lookahead of the replay
holds the newest messages back; with ``idle_ms`` a book that had no messages for so long is finished.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.operators.book import BUY, LOOKAHEAD, Event, SymbolReplay
from tapeloom.operators.replay import EVENT_COLUMNS, FILL_SCHEMA, extract_events


def stream_fills(orders: DataFrame, previous_close: dict[str, int] | None = None, lookahead: int = LOOKAHEAD, order_by: Column | str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Trades of a streaming DataFrame of orders, in append mode."""
    closes = previous_close or {}
    names = [x.split()[0] for x in FILL_SCHEMA.split(", ")]

    def rows(symbol: str, fills: list) -> pd.DataFrame:
        out = pd.DataFrame([(symbol, f.ts, f.price, f.quantity, f.buy_order, f.sell_order, "B" if f.aggressor == BUY else "S") for f in fills], columns=names)
        out["txn_time"] = pd.to_datetime(out["txn_time"], unit="us")
        return out

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbol = key[1]
        replay = pickle.loads(state.get[0]) if state.exists else SymbolReplay(symbol, lookahead, closes.get(symbol))
        if state.hasTimedOut:
            state.remove()
            yield rows(symbol, list(replay.finish()))
            return
        frame = pd.concat(list(batches)).sort_values("seq")
        fills = [f for r in frame[list(EVENT_COLUMNS)].itertuples(index=False, name=None) for f in replay.feed(Event._make(r))]
        state.update((pickle.dumps(replay),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield rows(symbol, fills)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    events = extract_events(orders, order_by).groupBy("day", "symbol")
    return events.applyInPandasWithState(step, FILL_SCHEMA, "replay binary", "append", timeout)
