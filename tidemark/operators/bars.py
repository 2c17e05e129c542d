"""Bars: from ticks, from two sides, to wider bars, and their returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.axis import Axis, col
from ..functions.scalar import right_label, utc

SECONDS = {"1min": 60, "5min": 300, "15min": 900, "30min": 1800, "1h": 3600, "4h": 14400, "1D": 86400}
BARS_PER_YEAR = {"1min": 372_000, "5min": 74_400, "15min": 24_800, "30min": 12_400, "1h": 6_200, "4h": 1_550, "1D": 252}


def width(timeframe: str) -> int:
    """Seconds of a bar; the price convention in a name such as ``1h_mid`` does not matter."""
    name = timeframe.removesuffix("_mid").removesuffix("_bid").removesuffix("_ask")
    if name not in SECONDS:
        raise ValueError(f"unknown timeframe {timeframe}")
    return SECONDS[name]


def normalize_index(df: DataFrame, axis: Axis = Axis(), sequence: str = "ingest_seq") -> DataFrame:
    """UTC timestamps and, of rows of a series with equal times, the first by ``sequence``.

    Rows without time are left out.
    """
    df = df.withColumn(axis.ts, utc(axis.ts)).where(F.col(axis.ts).isNotNull())
    first = Window.partitionBy(*axis.keys, axis.ts).orderBy(sequence)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def _first(x: str, order: Column) -> Column:
    return F.min_by(x, F.when(F.col(x).isNotNull(), order))


def _last(x: str, order: Column) -> Column:
    return F.max_by(x, F.when(F.col(x).isNotNull(), order))


def resample_bars(bars: DataFrame, rule: str, axis: Axis = Axis(), start_labels: bool = False) -> DataFrame:
    """Wider bars in right-closed buckets, labelled by their end.

    Open and close are the first and last not-null ones; a bucket without any
    close is left out.  ``start_labels`` is for bars that carry the time of
    their start: it counts a bar where its end falls, labels staying starts.
    """
    seconds = width(rule)
    label = F.timestamp_micros((F.floor(F.unix_micros(axis.ts) / float(seconds * 1_000_000)) * seconds * 1_000_000).cast("long")) if start_labels else right_label(axis.ts, seconds)
    at = F.struct(axis.ts, *axis.tie)
    sums = {"open": _first("open", at), "high": F.max("high"), "low": F.min("low"), "close": _last("close", at)}
    sums |= {"volume": F.sum("volume")} if "volume" in bars.columns else {}
    sums |= {"spread": F.avg("spread")} if "spread" in bars.columns else {}
    wide = bars.withColumn("__label", label).groupBy(*axis.keys, "__label").agg(*(c.alias(k) for k, c in sums.items()))
    return wide.where("close is not null").withColumnRenamed("__label", axis.ts)


def ticks_to_bars(ticks: DataFrame, rule: str, price: str = "px", axis: Axis = Axis(tie=("seq",))) -> DataFrame:
    """Right-closed bars of a tick price; volume counts ticks."""
    at = F.struct(axis.ts, *axis.tie)
    label = right_label(axis.ts, width(rule))
    t = ticks.where(F.col(price).isNotNull() & F.col(axis.ts).isNotNull()).withColumn("__label", label)
    bars = t.groupBy(*axis.keys, "__label").agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return bars.withColumnRenamed("__label", axis.ts)


def mid_bars(bars: DataFrame, axis: Axis = Axis(), side: str = "side") -> DataFrame:
    """Mid bars of times that have both a bid and an ask bar, with the closing spread.

    One pass over both sides; the mid of highs and of lows is approximate, as
    the sides' extremes need not fall together.
    """
    pick = lambda s, c: F.max(F.when(F.col(side) == s, F.col(c)))
    mid = [((pick("bid", c) + pick("ask", c)) / 2).alias(c) for c in ("open", "high", "low", "close")]
    both = F.count_distinct(F.when(F.col(side).isin("bid", "ask"), F.col(side)))
    out = bars.groupBy(*axis.keys, axis.ts).agg(*mid, F.sum("volume").alias("volume"), (pick("ask", "close") - pick("bid", "close")).alias("spread"), both.alias("__sides"))
    return out.where("__sides = 2").drop("__sides")


def log_return(axis: Axis, x: str | Column = "close", n: int = 1) -> Column:
    return F.log(col(x) / axis.lag(x, n))


def forward_return(axis: Axis, x: str | Column = "close", horizon: int = 1) -> Column:
    """ln of the price ``horizon`` rows ahead over this one: the target, and the only look ahead."""
    return F.log(axis.lead(x, horizon) / col(x))


def with_mid_close(bars: DataFrame, axis: Axis = Axis()) -> DataFrame:
    """Times and closes of the mid side only."""
    return bars.where("side = 'mid'").select(*axis.keys, axis.ts, "close")


def common_times(bars: DataFrame, axis: Axis = Axis(), symbols: list[str] | None = None) -> DataFrame:
    """Bars of the times at which every symbol has a close.

    Symbols are counted per time with a partial sum, so no time is a hot key.
    """
    key = axis.keys[0]
    have = bars.where("close is not null")
    have = have.where(F.col(key).isin(symbols)) if symbols else have
    n = F.lit(len(set(symbols))) if symbols else None
    full = have.groupBy(axis.ts).agg(F.count_distinct(key).alias("__n"))
    if n is None:
        full = full.crossJoin(F.broadcast(have.agg(F.count_distinct(key).alias("__all")))).where("__n = __all")
    else:
        full = full.where(F.col("__n") == n)
    return have.join(full.select(axis.ts), axis.ts, "left_semi")


def pair_returns(bars: DataFrame, axis: Axis = Axis(), symbols: list[str] | None = None) -> DataFrame:
    """(symbol, ts, r): log returns between neighbouring times that all symbols share."""
    r = common_times(bars, axis, symbols).withColumn("r", log_return(axis))
    return r.where("r is not null").select(*axis.keys, axis.ts, "r")
