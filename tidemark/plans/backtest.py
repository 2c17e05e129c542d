"""Walk-forward backtests of many models and symbols as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis, in_chunks, running
from ..operators.costs import CostModel, Kelly, agreement_filter, apply_costs, freeze_outside, lagged_vol, mean_holding, size_positions
from ..operators.metrics import bootstrap_sharpe, summarize
from ..operators.models import Model, Splitter, ensemble, first_fold, walk_forward
from ..session import cut


@dataclass(frozen=True)
class Backtest:
    """Tables of a run, keyed by symbol and model."""

    predictions: DataFrame
    returns: DataFrame
    gross: DataFrame
    net: DataFrame
    folds: DataFrame
    degeneracy: DataFrame
    ci: DataFrame


def positions_to_returns(df: DataFrame, axis: Axis, cost: CostModel, carry_annual: str | None = None) -> DataFrame:
    """The position of the bar before earns the bar's market return; then costs.

    Rows without a position before are left out, and costs are taken on what
    remains, so the first of them pays for its whole position.
    """
    df = cut(df)
    held = running(df, axis, {"__was": ("prev", F.col("position"))}).withColumn("gross", F.col("__was") * F.col("market")).where("gross is not null").drop("__was")
    return apply_costs(held, cost, axis, carry_annual=carry_annual)


def run_backtest(
    data: DataFrame, axis: Axis, splitter: Splitter, models: dict[str, Model], cost: CostModel = CostModel(), kelly: Kelly = Kelly(), bars_per_year: int = 24_800,
    vol_window: int = 96, carry_annual: str | None = None, allowed_hours: list[int] | None = None, members: dict[str, Model] | None = None, min_agreement: float | None = None, resamples: int = 0,
) -> Backtest:
    """``data`` (keys, ts, f_*, y, market) through fit, predict, size, shift and cost.

    ``members`` form a further model ``ensemble``: their mean, zeroed where
    fewer than ``min_agreement`` of them agree.  Without a least edge in
    ``kelly`` the hurdle is the round trip over each model's mean holding.
    """
    data = in_chunks(data, axis, lambda d, a: d.withColumn("vol", lagged_vol(a, "market", vol_window)), back=vol_window)
    raw = walk_forward(data, axis, splitter, models) if models else None
    if members:
        each = walk_forward(data, axis, splitter, members)
        row = [*axis.keys, axis.ts, "pos", "n", "fold", "market", "vol", "y"]
        mean = ensemble(each, row)
        p = agreement_filter("mean", "agreement", min_agreement) if min_agreement is not None else F.col("mean")
        mean = mean.select(*row, p.alias("prediction")).withColumn("model", F.lit("ensemble"))
        raw = mean if raw is None else raw.select(*mean.columns).unionByName(mean)
    own = Axis((*axis.keys, "model"), axis.ts, axis.tie)
    keys = list(own.keys)
    extra = [carry_annual] if carry_annual else []
    raw = raw.select(*keys, axis.ts, "pos", "fold", "market", "vol", "y", "prediction", *extra)
    raw = cut(raw)  # read by the folds' figures, the hurdle and the positions
    pred = first_fold(raw, axis)
    if kelly.min_edge is None:
        hurdle = mean_holding(pred, own, "prediction").select(*keys, (F.lit(cost.breakeven) / F.col("holding_bars")).alias("min_edge"))
        sized = pred.join(hurdle, keys).withColumn("position", size_positions("prediction", "vol", kelly, F.col("min_edge")))
    else:
        sized = pred.withColumn("min_edge", F.lit(kelly.min_edge)).withColumn("position", size_positions("prediction", "vol", kelly))
    if allowed_hours is not None:
        sized = freeze_outside(sized, own, allowed_hours)
    returns = cut(positions_to_returns(sized, own, cost, carry_annual))
    gross = summarize(returns, own, "gross", bars_per_year, "position")
    net = summarize(returns, own, "net", bars_per_year, "position")
    folds = fold_metrics(raw, own, cost, kelly, bars_per_year)
    ci = bootstrap_sharpe(returns, own, "net", bars_per_year, resamples=resamples) if resamples else net.select(*keys, F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    return Backtest(pred, returns, gross, net, folds, degeneracy(returns, net, folds, own), ci)


def fold_metrics(raw: DataFrame, axis: Axis, cost: CostModel, kelly: Kelly, bars_per_year: int) -> DataFrame:
    """(keys, fold, sharpe, net_return, hit_rate, n_test): each fold on its own, without hurdle or freezing."""
    own = Axis((*axis.keys, "fold"), axis.ts, axis.tie)
    sized = raw.withColumn("position", size_positions("prediction", "vol", kelly))
    n = sized.groupBy(*own.keys).agg(F.count(F.lit(1)).alias("n_test"))
    returns = positions_to_returns(sized, own, cost)
    live = returns.groupBy(*own.keys).agg(F.stddev_samp("gross").alias("__sd"))
    stats = summarize(returns, own, "net", bars_per_year, "position").join(live, list(own.keys))
    ok = F.coalesce(F.col("__sd") > 0, F.lit(False))
    stats = stats.select(*own.keys, *(F.when(ok, F.col(c)).alias(a) for c, a in (("sharpe", "sharpe"), ("total_return", "net_return"), ("hit_rate", "hit_rate"))))
    return n.join(stats, list(own.keys), "left")


def degeneracy(returns: DataFrame, net: DataFrame, folds: DataFrame, axis: Axis) -> DataFrame:
    """(keys, reasons): why a result is no evidence; an empty list if nothing speaks against it."""
    keys = list(axis.keys)
    active = returns.groupBy(*keys).agg(F.avg((F.coalesce("position", F.lit(0.0)) != 0).cast("double")).alias("active"))
    spread = folds.groupBy(*keys).agg(F.count("sharpe").alias("finite"), F.stddev_samp("sharpe").alias("fold_std"))
    df = net.join(active, keys).join(spread, keys, "left")
    reasons = [
        F.when(F.coalesce("turnover", F.lit(0.0)) < 1, "turnover below 1 a year"),
        F.when(F.col("active") < 0.01, "active in less than 1 % of bars"),
        F.when(F.coalesce("finite", F.lit(0)) < 3, "fewer than 3 folds with a Sharpe ratio"),
        F.when(F.col("fold_std").isNull(), "no spread between folds"),
        F.when(F.col("n_bars") < 100, "fewer than 100 bars"),
    ]
    return df.select(*keys, F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))


def leaderboard(result: Backtest, axis: Axis) -> DataFrame:
    """Net beside gross for each model, best net Sharpe first."""
    keys = [*axis.keys, "model"]
    g = result.gross.select(*keys, F.col("sharpe").alias("gross_sharpe"), F.col("total_return").alias("gross_return"))
    n = result.net.select(*keys, "n_bars", F.col("sharpe").alias("net_sharpe"), F.col("total_return").alias("net_return"), "max_drawdown", "turnover", "hit_rate")
    return g.join(n, keys).join(result.degeneracy, keys).orderBy(F.desc_nulls_last("net_sharpe"), *keys)
