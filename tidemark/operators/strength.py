"""Currency strength from pair returns, and cross-sectional books of pairs.

The long form (ts, pair, r) is the canonical one.  The fixed linear maps
between pairs and currencies are eight by eight tables, joined by broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.axis import Axis, in_chunks, running
from ..functions.scalar import divide
from ..session import cut
from .ewm import ewm_mean

# Base and quote currency of each pair.
PAIR_LEGS = {"EURUSD": ("EUR", "USD"), "GBPUSD": ("GBP", "USD"), "AUDUSD": ("AUD", "USD"), "NZDUSD": ("NZD", "USD"), "USDJPY": ("USD", "JPY"), "USDCHF": ("USD", "CHF"), "USDCAD": ("USD", "CAD")}
CURRENCIES = tuple(sorted({c for legs in PAIR_LEGS.values() for c in legs}))  # any order gives the same values


def touched(pairs: list[str]) -> list[str]:
    legs = {c for p in pairs for c in PAIR_LEGS[p]}
    return [c for c in CURRENCIES if c in legs]


def incidence(pairs: list[str], currencies: list[str]) -> np.ndarray:
    a = np.zeros((len(pairs), len(currencies)))
    for i, p in enumerate(pairs):
        for leg, s in zip(PAIR_LEGS[p], (1.0, -1.0), strict=True):
            if leg in currencies:
                a[i, currencies.index(leg)] = s
    return a


def strength_weights(pairs: list[str], currencies: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Currencies and the matrix from pair returns to currency returns that sum to zero."""
    if not pairs:
        raise ValueError("no known pair")
    reach = touched(pairs)
    currencies = currencies or reach
    if lost := set(currencies) - set(reach):
        raise ValueError(f"no pair covers {sorted(lost)}")
    a = np.vstack([incidence(pairs, currencies), np.ones(len(currencies))])
    return currencies, np.linalg.pinv(a)[:, : len(pairs)]


def _table(spark: SparkSession, pairs: list[str], currencies: list[str], w: np.ndarray) -> DataFrame:
    rows = [(p, c, float(w[j, i])) for i, p in enumerate(pairs) for j, c in enumerate(currencies)]
    return F.broadcast(spark.createDataFrame(rows, "pair string, ccy string, w double"))  # 7 x 8 rows at most


def currency_returns(pair_returns: DataFrame, pairs: list[str], currencies: list[str] | None = None) -> DataFrame:
    """(ts, ccy, r) from (ts, pair, r); null at times where a pair is missing."""
    names, w = strength_weights(pairs, currencies)
    table = _table(pair_returns.sparkSession, pairs, names, w)
    out = pair_returns.where(F.col("pair").isin(pairs)).join(table, "pair").groupBy("ts", "ccy").agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.count("r").alias("__n"))
    return out.withColumn("r", F.when(F.col("__n") == len(pairs), F.col("r"))).drop("__n")


def strength_ratings(ccy_returns: DataFrame, halflife: float, value: str = "r", into: str = "rating") -> DataFrame:
    """Exponentially weighted mean return of each currency."""
    return ewm_mean(ccy_returns, Axis(("ccy",)), {into: (value, halflife)})


def strength_features(pair_returns: DataFrame, pairs: list[str], target: str = "EURUSD", halflives: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """(ts, f_ccy_*, f_dollar_*): a row for each time, for the target pair."""
    base, quote = PAIR_LEGS[target]
    ccy = cut(currency_returns(pair_returns, pairs))  # read for ranks and for ratings
    at = Window.partitionBy("ts")
    tied = Window.partitionBy("ts", "r")
    rank = (F.rank().over(at.orderBy("r")) + (F.count("r").over(tied) - 1) / 2.0) / F.count("r").over(at)
    ranked = ccy.where("r is not null").withColumn("rank", rank)
    of = lambda c, v: F.max(F.when(F.col("ccy") == c, F.col(v)))
    rated = ewm_mean(ccy, Axis(("ccy",)), {f"s{h}": ("r", h) for h in halflives})
    cols = []
    for h in halflives:
        s = f"s{h}"
        cols += [(of(base, s) - of(quote, s)).alias(f"f_ccy_diff_{h}"), of(base, s).alias(f"f_ccy_base_{h}"), of(quote, s).alias(f"f_ccy_quote_{h}"), of("USD", s).alias(f"f_dollar_{h}"), F.stddev_samp(s).alias(f"f_ccy_dispersion_{h}")]
    wide = rated.groupBy("ts").agg(*cols)
    legs = ranked.groupBy("ts").agg(of(base, "rank").alias("f_ccy_rank_base"), of(quote, "rank").alias("f_ccy_rank_quote"))
    wide = wide.join(legs, "ts", "left").withColumn("pair", F.lit(target))
    from .features import zscore

    rows = {h: max(20, 4 * h) for h in halflives}
    z = lambda d, a: d.withColumns({f"f_ccy_diff_z_{h}": zscore(a, f"f_ccy_diff_{h}", n, n // 2) for h, n in rows.items()})
    return in_chunks(wide, Axis(("pair",)), z, back=max(rows.values()))


def cross_sectional_scores(ratings: DataFrame, value: str = "rating", into: str = "score") -> DataFrame:
    """Ratings less their mean at each time."""
    return ratings.withColumn(into, F.col(value) - F.avg(value).over(Window.partitionBy("ts")))


def currency_weights(scores: DataFrame, reversion: bool = True, gross: float = 1.0, into: str = "w") -> DataFrame:
    """Weights against (or with) the scores whose sizes add up to ``gross``; 0 where all scores are."""
    total = F.sum(F.abs("score")).over(Window.partitionBy("ts"))
    return scores.withColumn(into, F.coalesce(divide(F.col("score") * (-gross if reversion else gross), total), F.lit(0.0)))


def pair_positions(weights: DataFrame, pairs: list[str]) -> DataFrame:
    """(ts, pair, position): the smallest pair positions that give the currency weights."""
    names = touched(pairs)
    back = np.linalg.pinv(incidence(pairs, names).T)  # pairs x currencies
    table = _table(weights.sparkSession, pairs, names, back.T)
    return weights.join(table.withColumnRenamed("w", "__b"), "ccy").groupBy("ts", "pair").agg(F.sum(F.col("__b") * F.col("w")).alias("position"))


def cross_sectional_book(pair_returns: DataFrame, pairs: list[str], halflife: float = 5, reversion: bool = True, gross: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Pair positions and currency weights from pair returns."""
    ratings = strength_ratings(currency_returns(pair_returns, pairs), halflife)
    weights = currency_weights(cross_sectional_scores(ratings), reversion, gross).select("ts", "ccy", "w")
    return pair_positions(weights, pairs), weights


def portfolio_returns(positions: DataFrame, pair_returns: DataFrame) -> DataFrame:
    """(ts, portfolio_return, turnover): yesterday's positions earn today's returns; the first time earns 0."""
    both = running(cut(positions.join(pair_returns, ["ts", "pair"])), Axis(("pair",)), {"__was": ("prev", F.col("position"))})
    both = both.withColumns({"__earned": F.col("__was") * F.col("r"), "__traded": F.abs(F.col("position") - F.coalesce("__was", F.lit(0.0)))})
    return both.groupBy("ts").agg(F.coalesce(F.sum("__earned"), F.lit(0.0)).alias("portfolio_return"), F.sum("__traded").alias("turnover"))


def portfolio_diagnostics(positions: DataFrame, weights: DataFrame, pairs: list[str]) -> DataFrame:
    """One row: how well pairs replicate the weights, gross and net exposure, dollar exposure, netting."""
    names = touched(pairs)
    table = _table(positions.sparkSession, pairs, names, incidence(pairs, names).T)
    got = positions.join(table.withColumnRenamed("w", "__a"), "pair").groupBy("ts", "ccy").agg(F.sum(F.col("__a") * F.col("position")).alias("achieved"))
    both = weights.join(got, ["ts", "ccy"], "left").withColumn("achieved", F.coalesce("achieved", F.lit(0.0)))
    by = both.groupBy("ts").agg(F.max(F.abs(F.col("achieved") - F.col("w"))).alias("residual"), F.sum(F.abs("w")).alias("gross_ccy"), F.abs(F.sum("achieved")).alias("net"), F.abs(F.sum(F.when(F.col("ccy") == "USD", F.col("achieved")))).alias("usd"))
    gross = positions.groupBy("ts").agg(F.sum(F.abs("position")).alias("gross_pair"))
    one = by.join(gross, "ts").agg(
        F.max("residual").alias("max_replication_residual"), F.avg("gross_pair").alias("mean_gross_pair_exposure"), F.avg("gross_ccy").alias("mean_gross_ccy_exposure"),
        F.max("net").alias("max_abs_net_exposure"), F.avg("usd").alias("mean_abs_usd_exposure"),
    )
    return one.withColumn("netting_ratio", F.col("mean_gross_pair_exposure") / F.greatest(F.col("mean_gross_ccy_exposure"), F.lit(1e-12)))
