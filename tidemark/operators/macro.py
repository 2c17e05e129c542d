"""Rates, weekly positioning and trailing regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.axis import CHUNK, Axis, in_chunks, rolling_extremes, trailing_below
from ..functions.scalar import divide
from .asof import align_positioning, asof_series

# The policy rates behind each pair, base and quote.
RATE_LEGS = {"EURUSD": ("ECBDFR", "DFF")}
COHORTS = ("lev", "asset_mgr", "dealer")


def rate_differential(base: DataFrame, quote: DataFrame, changes: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """(obs_date, base, quote, diff, chg_*): daily series of both rates, the last known value of each, and changes over rows.

    Days before both are known are left out.  A macro series is a row a day.
    """
    b = base.select("obs_date", F.col("value").alias("base"))
    q = quote.select("obs_date", F.col("value").alias("quote"))
    w = Window.partitionBy(F.lit(0)).orderBy("obs_date")
    wall = w.rowsBetween(Window.unboundedPreceding, 0)
    daily = b.join(q, "obs_date", "full").select("obs_date", F.last("base", True).over(wall).alias("base"), F.last("quote", True).over(wall).alias("quote")).dropna()
    daily = daily.withColumn("diff", F.col("base") - F.col("quote"))
    return daily.withColumns({f"chg_{n}": F.col("diff") - F.lag("diff", n).over(w) for n in changes})


def with_rate_features(bars: DataFrame, daily: DataFrame, axis: Axis = Axis(), lag_days: int = 1) -> DataFrame:
    """``bars`` with f_rate_* of a daily differential, published ``lag_days`` later."""
    if lag_days < 1:
        raise ValueError("lag_days must be at least 1")
    changes = [c for c in daily.columns if c.startswith("chg_")]
    out = asof_series(bars, daily, axis.ts, "obs_date", ["base", "quote", "diff", *changes], lag_days, "__rate")
    cols = {"f_rate_diff": F.col("__rate.diff")} | {f"f_rate_diff_{c}d": F.col(f"__rate.{c}") for c in changes}
    return out.withColumns(cols | {"f_rate_base": F.col("__rate.base"), "f_rate_quote": F.col("__rate.quote")}).drop("__rate")


def range_positions(df: DataFrame, axis: Axis, into: dict[str, str], n: int, least: int) -> DataFrame:
    """``df`` with where each named column's value stands between the least and largest of ``n`` trailing rows."""
    ends = {f"__{side}_{c}": (side, x) for c, x in into.items() for side in ("min", "max")}
    df = rolling_extremes(df, axis, ends, n, least)
    low, high = (lambda c: F.col(f"__min_{c}")), (lambda c: F.col(f"__max_{c}"))
    return df.withColumns({c: divide(F.col(x) - low(c), high(c) - low(c)) for c, x in into.items()}).drop(*ends)


def with_positioning_features(bars: DataFrame, cot: DataFrame, base: str, quote: str, axis: Axis = Axis(), weeks: int = 156, release_lag_days: int = 6) -> DataFrame:
    """``bars`` with f_cot_* levels and range positions of each leg, and the pair's differential.

    USD has no contract of its own: it is the other side of all of them.  A
    leg without any report has no columns.  Range positions are taken on
    chunks of a series, at a cost that does not depend on ``weeks``.
    """
    out = bars
    legs = []
    known = {r[0] for r in cot.where(F.col("currency").isin(base, quote)).select("currency").distinct().collect()}
    for role, ccy in (("base", base), ("quote", quote)):
        if ccy == "USD" or ccy not in known:
            continue
        legs.append(role)
        out = align_positioning(out, cot, ccy, release_lag_days, axis.ts, "__cot")
        out = out.withColumns({f"f_cot_{role}_{c}": F.col(f"__cot.net_{c}") for c in COHORTS}).drop("__cot")
    n = weeks * 5
    places = {f"f_cot_{r}_{c}_pct": f"f_cot_{r}_{c}" for r in legs for c in COHORTS}
    if legs:
        out = in_chunks(out, axis, lambda d, a: range_positions(d, a, places, n, 100), back=n)
    lev = lambda r: F.col(f"f_cot_{r}_lev")
    diff = {("base", "quote"): lambda: lev("base") - lev("quote"), ("base",): lambda: lev("base"), ("quote",): lambda: -lev("quote")}
    return out.withColumn("f_cot_diff_lev", diff[tuple(legs)]()) if legs else out


def trailing_rank(axis: Axis, x: str, n: int) -> Column:
    """Share of the other ``n`` trailing rows that are below; nulls count as rows and are below nothing.

    A window of fewer than n/2 values has none.  The list of a row's window is
    held, so this form is for short windows; ``with_trailing_rank`` is for all.
    """
    w = axis.trailing(n)
    rows = F.collect_list(F.struct(F.col(x).alias("v"))).over(w)
    below = F.size(F.filter(rows, lambda r: r["v"] < F.col(x)))
    return F.when(F.count(x).over(w) >= n // 2, divide(below, F.size(rows) - 1))


def with_trailing_rank(df: DataFrame, axis: Axis, x: str, n: int, into: str) -> DataFrame:
    """``df`` with ``trailing_rank`` at a cost that does not depend on ``n``: ranks from a merge-sort tree, counts from running ones."""
    df = trailing_below(df, axis, x, n, "__below").withColumn("__known", F.count(x).over(axis.wall))
    known = F.col("__known") - F.coalesce(F.lag("__known", n).over(axis.ordered), F.lit(0))
    rows = F.least(F.row_number().over(axis.ordered), F.lit(n))
    return df.withColumn(into, F.when(known >= n // 2, divide(F.col("__below"), rows - 1))).drop("__below", "__known")


def _regime(df: DataFrame, axis: Axis, x: str, regimes: int, n: int, into: str) -> DataFrame:
    df = with_trailing_rank(df, axis, x, n, "__rank")
    df = df.withColumn("__rank", axis.lag("__rank"))
    steps = [F.when(F.col("__rank") >= k / regimes, 1).otherwise(0) for k in range(1, regimes)]
    return df.withColumn(into, F.when(F.col("__rank").isNotNull(), sum(steps, F.lit(0)))).drop("__rank")


def quantile_regime(df: DataFrame, axis: Axis, x: str, regimes: int = 2, n: int = 250, into: str = "regime", size: int = CHUNK) -> DataFrame:
    """``df`` with the regime (from 0) of the value known one row before, by its trailing rank.

    Chunks of a series are ranked by themselves, each with the n rows before it.
    """
    return in_chunks(df, axis, lambda d, a: _regime(d, a, x, regimes, n, into), back=n, size=size)


def vol_regime(df: DataFrame, axis: Axis, ret: str, window: int = 20, regimes: int = 2, n: int = 250, into: str = "regime", size: int = CHUNK) -> DataFrame:
    def op(d: DataFrame, a: Axis) -> DataFrame:
        d = d.withColumn("__vol", a.rolling(F.stddev_samp, ret, window))
        return _regime(d, a, "__vol", regimes, n, into).drop("__vol")

    return in_chunks(df, axis, op, back=n + window, size=size)
