"""Price features, targets and complete-case datasets.  All look back only, but for the target."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis, col, in_chunks
from ..functions.scalar import divide
from .bars import BARS_PER_YEAR, forward_return, log_return
from .ewm import ewm_recursive

PREFIX = "f_"


def realized_vol(axis: Axis, ret: str | Column, n: int, timeframe: str) -> Column:
    """Annualised deviation of ``n`` returns; an unknown timeframe counts 252 bars a year."""
    return axis.rolling(F.stddev_samp, ret, n) * math.sqrt(BARS_PER_YEAR.get(timeframe, 252))


def zscore(axis: Axis, x: str | Column, n: int, least: int | None = None) -> Column:
    return divide(col(x) - axis.rolling(F.avg, x, n, least), axis.rolling(F.stddev_samp, x, n, least))


def true_range(axis: Axis) -> Column:
    """The widest of high - low and the gaps to the last close; nulls are skipped."""
    last = axis.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def position_in_range(axis: Axis, n: int) -> Column:
    low, high = axis.rolling(F.min, "low", n), axis.rolling(F.max, "high", n)
    return divide(F.col("close") - low, high - low)


def _bounded(df: DataFrame, axis: Axis, timeframe: str, momentum: tuple[int, ...], vol: tuple[int, ...], horizon: int) -> DataFrame:
    """What needs a bounded number of rows around: all but the recursive means."""
    step = F.col("close") - axis.lag("close")
    df = df.withColumns({"f_ret_1": log_return(axis), "__tr": true_range(axis), "gain__": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "loss__": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))})
    cols = {}
    for n in momentum:
        cols[f"f_mom_{n}"] = axis.rolling(F.sum, "f_ret_1", n)
        cols[f"f_pos_in_range_{n}"] = position_in_range(axis, n)
    for n in vol:
        cols[f"f_vol_{n}"] = realized_vol(axis, "f_ret_1", n, timeframe)
        cols[f"f_z_close_{n}"] = zscore(axis, "close", n)
    cols["f_atr_14"] = axis.rolling(F.avg, "__tr", 14) / F.col("close")
    if horizon:
        cols["y"] = forward_return(axis, horizon=horizon)
    return df.withColumns(cols).drop("__tr")


def with_rsi(df: DataFrame, axis: Axis, pos: str, n: int = 14) -> DataFrame:
    """``df`` (gain__, loss__) with relative strength in [0, 1]; null while there is no loss.

    The second row of a series has the first gain or loss.
    """
    df = ewm_recursive(df, axis, {"up__": "gain__", "down__": "loss__"}, 1.0 / n, F.col(pos) == 1, pos)
    return df.withColumn(f"f_rsi_{n}", 1 - 1 / (1 + divide("up__", "down__"))).drop("gain__", "loss__", "up__", "down__")


def price_features(bars: DataFrame, timeframe: str, axis: Axis = Axis(), momentum: tuple[int, ...] = (4, 12, 48), vol: tuple[int, ...] = (24, 96), chunked: bool = True, horizon: int = 0) -> DataFrame:
    """``bars`` (closes known) with 16 feature columns named f_*.

    With ``chunked``, a series is worked on in overlapping chunks of rows, so
    that a few long series still fill a cluster; the result is the same.
    ``horizon`` adds the target ``y``, the return of so many bars ahead.
    """
    missing = {"open", "high", "low", "close"} - set(bars.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    work = lambda df, a: _bounded(df, a, timeframe, momentum, vol, horizon)
    if chunked:
        df = in_chunks(bars, axis, work, back=max(*momentum, *vol) + 1, ahead=horizon, keep="pos__")
    else:
        df = work(bars, axis).withColumn("pos__", F.row_number().over(axis.ordered) - 1)
    df = with_rsi(df, axis, "pos__").drop("pos__")
    turn = 2 * math.pi * (F.hour(axis.ts) + F.minute(axis.ts) / 60.0) / 24
    return df.withColumns({"f_hour_sin": F.sin(turn), "f_hour_cos": F.cos(turn), "f_dayofweek": F.weekday(axis.ts) / 4.0})


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PREFIX)]


def complete_cases(df: DataFrame, target: str = "y") -> DataFrame:
    return df.dropna(how="any", subset=[*feature_columns(df), target])


def assemble_dataset(bars: DataFrame, timeframe: str, axis: Axis = Axis(), horizon: int = 1, macro: DataFrame | None = None, macro_lag_days: int = 1, chunked: bool = True) -> DataFrame:
    """Features, target ``y`` and one-bar ``market`` return of the rows where all of them are known."""
    df = price_features(bars, timeframe, axis, chunked=chunked, horizon=horizon)
    if macro is not None:
        from .macro import with_rate_features

        df = with_rate_features(df, macro, axis, macro_lag_days)
    return complete_cases(df.withColumn("market", F.col("f_ret_1")))


def families(columns: list[str]) -> dict[str, list[str]]:
    """Feature columns by family, empty ones left out."""
    kind = lambda c: "carry" if c.startswith("f_rate") else "strength" if c.startswith(("f_ccy", "f_dollar")) else "price"
    out: dict[str, list[str]] = {}
    for c in columns:
        if c.startswith(PREFIX):
            out.setdefault(kind(c), []).append(c)
    return out
