"""Ticks to bars, as-of values and working limit orders on streams.

Batch results are the truth: on a replayed stream each of these gives the rows
that the batch operator gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import width


def stream_bars(ticks: DataFrame, rule: str, late: str = "10 minutes", price: str = "px") -> DataFrame:
    """Right-closed bars of (symbol, ts, price) that are final once the watermark has passed them.

    Event-time windows are closed on the left; a tick is therefore counted a
    microsecond earlier, which puts the one on a boundary into the bar it ends.
    """
    seconds = width(rule)
    shifted = ticks.withColumn("__t", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("__t", late)
    w = F.window("__t", f"{seconds} seconds")
    bars = shifted.groupBy("symbol", w.alias("w")).agg(F.min_by(price, "ts").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("symbol", F.col("w.end").alias("ts"), "open", "high", "low", "close", "volume")


def stream_limit_fills(orders_and_quotes: DataFrame) -> DataFrame:
    """Fills of limit orders from one stream of orders and quotes (symbol, ts, kind, order_id, side, limit_price, bid, ask).

    The state of a symbol is its open orders only.
    """
    out = "symbol string, order_id string, fill_ts timestamp, fill_price double"
    state = "order_id array<string>, side array<int>, limit_price array<double>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        ids, sides, limits = (list(x) for x in held.get) if held.exists else ([], [], [])
        rows = pd.concat(list(frames)).sort_values(["ts", "kind"], kind="stable")
        fills = []
        for r in rows.itertuples(index=False):
            if r.kind == "order":
                ids.append(r.order_id)
                sides.append(int(r.side))
                limits.append(float(r.limit_price))
                continue
            hit = [i for i in range(len(ids)) if (r.bid >= limits[i] if sides[i] == -1 else r.ask <= limits[i])]
            fills += [(key[0], ids[i], r.ts, limits[i]) for i in hit]
            for i in reversed(hit):
                del ids[i], sides[i], limits[i]
        held.update((ids, sides, limits))
        yield pd.DataFrame(fills, columns=["symbol", "order_id", "fill_ts", "fill_price"])

    return orders_and_quotes.groupBy("symbol").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)
