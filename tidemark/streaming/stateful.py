"""Streams whose state outlives a batch: working limit orders and recursive means.

Rows may come late and in any order, up to the stream's watermark.  What a row
means is settled only once the watermark has passed it, by event-time timers,
so the results do not depend on how rows were dealt over batches.  Rows behind
the watermark are left out by Spark.

State is kept in RocksDB: ``spark.sql.streaming.stateStore.providerClass`` has
to name its provider (``ROCKS``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAR = np.int64(2**62)
FILLS = "symbol string, order_id string, side int, limit_price double, fill_ts timestamp, fill_price double, reason string"


def _us(ts: pd.Series) -> np.ndarray:
    """Microseconds; those of a missing time are FAR."""
    t = pd.to_datetime(ts, utc=True)
    us = t.dt.as_unit("us").astype("int64").to_numpy().copy()
    us[t.isna().to_numpy()] = FAR
    return us


def _stamp(us: list[int | None]) -> pd.Series:
    return pd.to_datetime(pd.Series([None if u is None else u for u in us], dtype="Int64"), unit="us")


def _hold(state: ListState, rows: list[tuple]) -> None:
    state.put(rows) if rows else state.clear()


class WorkingOrders(StatefulProcessor):
    """Open orders of a symbol with the earliest quote so far that fills each, and the quotes ahead of the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("orders", "order_id string", "side int, limit_price double, from_us long, until_us long, fill_us long")
        self.quotes = handle.getListState("quotes", "us long, bid double, ask double")

    @staticmethod
    def first_fills(orders: list[tuple], quotes: np.ndarray) -> np.ndarray:
        """For each order (side, limit, from, until, ...) the earliest quote (us, bid, ask) that fills it; FAR if none does."""
        if not orders or not len(quotes):
            return np.full(len(orders), FAR)
        side, limit, since, until = (np.array([o[k] for o in orders])[:, None] for k in range(4))
        us, bid, ask = quotes[:, 0].astype(np.int64), quotes[:, 1], quotes[:, 2]
        hit = np.where(side == -1, bid >= limit, ask <= limit) & (us >= since) & (us <= until)
        return np.where(hit, us, FAR).min(1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for df in rows:
            us, is_order = _us(df["ts"]), (df["kind"] == "order").to_numpy()
            fresh = np.stack((us, df["bid"].to_numpy(float), df["ask"].to_numpy(float)), 1)[~is_order]
            held = np.array([tuple(q) for q in self.quotes.get()] if self.quotes.exists() else [], float).reshape(-1, 3)
            old = {k[0]: tuple(v) for k, v in self.orders.iterator()} if self.orders.exists() else {}
            names = list(old)
            better = self.first_fills([old[n] for n in names], fresh)
            for n, f in zip(names, better, strict=True):
                if f < old[n][4]:
                    self.orders.updateValue((n,), (*old[n][:4], int(f)))
            o = df[is_order]
            every = np.concatenate((held, fresh))
            until = _us(o["until_ts"]) if "until_ts" in o else np.full(len(o), FAR)
            new = [(int(s), float(p), int(a), int(b)) for s, p, a, b in zip(o["side"], o["limit_price"], us[is_order], until, strict=True)]
            for n, x, f in zip(o["order_id"], new, self.first_fills(new, every), strict=True):
                if n not in old:  # a repeated order is one
                    self.orders.updateValue((n,), (*x, int(f)))
            _hold(self.quotes, [(int(q[0]), float(q[1]), float(q[2])) for q in every if q[0] > mark])
        self._wait()
        yield from self._settle(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.quotes.exists():
            _hold(self.quotes, [tuple(q) for q in self.quotes.get() if q[0] > mark])
        yield from self._settle(key, mark)
        self._wait()

    def _wait(self) -> None:
        """A timer for the next order that is settled."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = [min(v[4], v[3]) for _, v in self.orders.iterator()] if self.orders.exists() else []
        if ends and min(ends) < FAR:
            self.handle.registerTimer(int(min(ends)) // 1000 + 1)

    def _settle(self, key, mark: int) -> Iterator[pd.DataFrame]:
        out = []
        for (n,), v in list(self.orders.iterator()) if self.orders.exists() else []:
            side, limit, _, until, fill = v
            if min(fill, until) >= mark:
                continue
            filled = fill <= until
            out.append((key[0], n, side, limit, fill if filled else None, limit if filled else None, "filled" if filled else "expired"))
            self.orders.removeKey((n,))
        if out:
            df = pd.DataFrame(out, columns=["symbol", "order_id", "side", "limit_price", "fill_ts", "fill_price", "reason"])
            yield df.assign(fill_ts=_stamp(df["fill_ts"].tolist()))

    def close(self) -> None: ...


def stream_orders(orders_and_quotes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Outcomes of limit orders from one stream of orders and quotes (symbol, ts, kind, order_id, side, limit_price, bid, ask, and optionally until_ts).

    An order works from its ``ts`` to its ``until_ts``, both included; without
    one it works until it is filled.  It fills at its limit at the first quote
    whose bid (a sale) or ask (a purchase) reaches it, by event time, and is
    ``expired`` once the watermark has passed its end.  Quotes are held only
    while they are ahead of the watermark.
    """
    marked = orders_and_quotes.withWatermark("ts", late)
    return marked.groupBy("symbol").transformWithStateInPandas(WorkingOrders(), FILLS, "Append", "EventTime")


class RecursiveMeans(StatefulProcessor):
    """Rows of a symbol ahead of the watermark, the last price and the running means of gains and losses and of the price."""

    def __init__(self, alpha: float, periods: int):
        self.alpha, self.beta = alpha, 1.0 / periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "us long, close double")
        self.last = handle.getValueState("last", "close double, mean double, up double, down double, rows long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            known = df[df["close"].notna()]
            if len(known):
                self.ahead.appendList([(int(u), float(c)) for u, c in zip(_us(known["ts"]), known["close"], strict=True)])
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, mark: int) -> Iterator[pd.DataFrame]:
        """Take in, by time, the rows that the watermark has passed; of rows of one instant the first that came."""
        ahead = sorted((tuple(x) for x in self.ahead.get()), key=lambda x: x[0]) if self.ahead.exists() else []
        due = [x for x in ahead if x[0] < mark]
        rest = [x for x in ahead if x[0] >= mark]
        _hold(self.ahead, rest)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        close, mean, up, down, n = self.last.get() if self.last.exists() else (None, None, None, None, 0)
        out, was = [], None
        for us, c in due:
            if us == was:
                continue
            was = us
            mean = c if n == 0 else (1 - self.alpha) * mean + self.alpha * c
            if n:
                gain, loss = max(c - close, 0.0), max(close - c, 0.0)
                up, down = (gain, loss) if n == 1 else ((1 - self.beta) * up + self.beta * gain, (1 - self.beta) * down + self.beta * loss)
            close, n = c, n + 1
            out.append((key[0], us, c, mean, 1 - 1 / (1 + up / down) if n > 1 and down else None))
        if out:
            self.last.update((close, mean, up, down, n))
            df = pd.DataFrame(out, columns=["symbol", "ts", "close", "ewm", "rsi"])
            yield df.assign(ts=_stamp(df["ts"].tolist()), rsi=df["rsi"].astype(float))

    def close(self) -> None: ...


def stream_means(bars: DataFrame, alpha: float, periods: int = 14, late: str = "2 hours") -> DataFrame:
    """(symbol, ts, close, ewm, rsi): the recursive mean of closes and their relative strength, row by row as the watermark passes.

    The same as ``ewm_recursive`` and ``with_rsi`` over the whole series, of
    which only the last row's means and the rows ahead of the watermark are held.
    """
    schema = "symbol string, ts timestamp, close double, ewm double, rsi double"
    own = bars.select("symbol", "ts", "close").withWatermark("ts", late)
    return own.groupBy("symbol").transformWithStateInPandas(RecursiveMeans(alpha, periods), schema, "Append", "EventTime")
