"""Forecast scores and tests that count dependent rows as one block.

Every test is two hash aggregates: blocks first, then the blocks' moments by
any grouping (feature, regime, hypothesis), so thousands of tests are one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.axis import Axis, in_chunks, running
from ..functions.ranks import ranked
from ..functions.scalar import LN2, brier, divide, log_loss
from ..functions.special import normal_quantile, p_two_sided, p_upper
from ..session import cut

EPS = 1e-15


def _score_columns(p: str, y: str) -> list[Column]:
    right = F.coalesce((F.col(p) > 0.5) == (F.col(y) == 1), F.lit(False))
    ll = F.avg(log_loss(p, y))
    return [F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"), ll.alias("log_loss"), (F.lit(LN2) - ll).alias("log_loss_edge"), F.avg(brier(p, y)).alias("brier"), F.avg(p).alias("mean_prob")]


def roc_auc(df: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """(keys, roc_auc) by rank sums, ties sharing ranks; null for a single class.

    Scores are dealt by ranges, so continuous scores of one key are ranked by
    many tasks.
    """
    df = df.withColumn("__one", F.when(F.col(y) == 1, 1).otherwise(0))
    by = ranked(df, keys, p, {"pos": F.sum("__one")})
    rank = F.col("below") + (F.col("here") + 1) / 2.0
    r = by.groupBy(*keys).agg(F.sum(rank * F.col("pos")).alias("r1"), F.sum("pos").alias("n1"), F.sum(F.col("here") - F.col("pos")).alias("n0"))
    auc = divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0"))
    return r.select(*keys, auc.alias("roc_auc"))


def score(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Accuracy, log loss, its edge over a coin, Brier, AUC and mean probability by ``keys``."""
    df = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    own = [F.col(k) for k in keys] or [F.lit(0).alias("__all")]
    df = df.select("*", *([] if keys else own))
    names = keys or ["__all"]
    out = df.groupBy(*names).agg(*_score_columns(p, y)).join(roc_auc(df, names, p, y), names)
    return out if keys else out.drop("__all")


def running_scores(df: DataFrame, p: str = "p", y: str = "y", ts: str = "ts") -> DataFrame:
    """Scores of each calendar year and, weighted by counts, of all years so far."""
    df = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("label", F.concat(F.year(ts).cast("string"), F.lit("-12-31")))
    by = score(df, ["label"], p, y)
    wall = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)  # a row for each year
    so_far = lambda c: F.sum(F.col(c) * F.col("n")).over(wall) / F.sum("n").over(wall)
    return by.withColumns({"cum_n": F.sum("n").over(wall), "cum_accuracy": so_far("accuracy"), "cum_log_loss": so_far("log_loss"), "cum_edge": so_far("log_loss_edge")})


def running_log_loss(df: DataFrame, axis: Axis, p: str = "p", y: str = "y", window: int | None = None) -> DataFrame:
    """``df`` with the mean loss so far, its edge over a coin and, optionally, the same over a window.

    Means so far come from sums of spans, the window's from chunks: no task
    sees a whole series.
    """
    df = cut(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("loss", log_loss(p, y)))
    df = running(df, axis, {"__sum": ("sum", F.col("loss")), "__rows": ("sum", F.lit(1))})
    df = df.withColumn("mean_loss", F.col("__sum") / F.col("__rows")).drop("__sum", "__rows").withColumn("edge", LN2 - F.col("mean_loss"))
    if not window:
        return df
    df = in_chunks(df, axis, lambda d, a: d.withColumn("rolling_loss", a.rolling(F.avg, "loss", window)), back=window)
    return df.withColumn("rolling_edge", LN2 - F.col("rolling_loss"))


def _moments(x: str) -> list[Column]:
    return [F.count(x).alias("n_effective"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("__sd"), F.avg(F.abs(x)).alias("__abs"), F.avg(F.when(F.col(x) > 0, 1.0).when(F.col(x).isNotNull(), 0.0)).alias("hit_rate")]


def _finish(m: DataFrame) -> DataFrame:
    """t and p from block moments; next to no spread, against the size of the mean, is no evidence."""
    m = m.withColumn("std_error", F.col("__sd") / F.sqrt(F.col("n_effective").cast("double")))
    scale = F.greatest(F.abs("mean"), F.col("__abs"), F.lit(EPS))
    t = F.when(F.col("std_error").isNotNull() & (F.col("std_error") > scale * 1e-10), F.col("mean") / F.col("std_error"))
    return m.withColumn("t_stat", t).withColumn("p_value", p_two_sided("t_stat", (F.col("n_effective") - 1).cast("double"))).drop("__sd", "__abs")


def block_test(df: DataFrame, keys: list[str], x: str, block: str | Column | None = None) -> DataFrame:
    """(keys, n_effective, mean, hit_rate, std_error, t_stat, p_value): is the mean of ``x`` above or below 0?

    ``block`` names what depends on each other; its rows count once, by their
    mean.  Groups of fewer than two blocks have no t.
    """
    df = df.where(F.col(x).isNotNull())
    names = keys or ["__all"]
    df = df if keys else df.withColumn("__all", F.lit(0))
    if block is not None:
        df = df.withColumn("__block", F.col(block) if isinstance(block, str) else block)
        df = df.groupBy(*names, "__block").agg(F.avg(x).alias(x))
    out = _finish(df.groupBy(*names).agg(*_moments(x)))
    return out if keys else out.drop("__all")


def paired_test(df: DataFrame, keys: list[str], model_loss: str, baseline_loss: str | float = LN2, block: str | Column | None = None) -> DataFrame:
    """Whether the model's loss is below the baseline's, row by row."""
    base = F.lit(baseline_loss) if isinstance(baseline_loss, float) else F.col(baseline_loss)
    out = block_test(df.withColumn("__d", base - F.col(model_loss)), keys, "__d", block).withColumnRenamed("mean", "mean_edge").drop("hit_rate")
    return out.withColumns({"ci_lo": F.col("mean_edge") - 1.96 * F.col("std_error"), "ci_hi": F.col("mean_edge") + 1.96 * F.col("std_error"), "model_better": F.col("mean_edge") > 0})


def signed_return_test(df: DataFrame, keys: list[str], prediction: str, realized: str, block: str | Column | None = None) -> DataFrame:
    """Whether the sign of the prediction earns the return."""
    df = df.withColumn("__pnl", F.signum(prediction) * F.col(realized))
    return block_test(df, keys, "__pnl", block).withColumnRenamed("mean", "mean_signed_return")


def conditional_test(df: DataFrame, feature: str, realized: str, regime: str, block: str | Column | None = None, least: int = 200) -> DataFrame:
    """The signed-return test in each regime that has at least ``least`` rows."""
    df = df.where(F.col(feature).isNotNull() & F.col(realized).isNotNull() & F.col(regime).isNotNull())
    rows = df.groupBy(regime).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)
    return signed_return_test(df, [regime], feature, realized, block).join(rows, regime)


def interaction_test(df: DataFrame, feature: str, realized: str, regime: str, block: str | Column | None = None) -> DataFrame:
    """Whether the feature earns differently in two regimes (Welch); one row.

    Any other number of regimes, or one with fewer than two blocks, is an error.
    """
    df = df.where(F.col(feature).isNotNull() & F.col(realized).isNotNull() & F.col(regime).isNotNull())
    m = df.withColumn("__pnl", F.signum(feature) * F.col(realized))
    if block is not None:
        m = m.withColumn("__block", F.col(block) if isinstance(block, str) else block).groupBy("__block", regime).agg(F.avg("__pnl").alias("__pnl"))
    groups = sorted(m.groupBy(regime).agg(F.count("__pnl").alias("n"), F.avg("__pnl").alias("m"), F.var_samp("__pnl").alias("v")).collect(), key=lambda r: r[0])
    if len(groups) != 2:
        raise ValueError(f"two regimes are needed, found {len(groups)}")
    if min(g["n"] for g in groups) < 2:
        raise ValueError("not enough observations in one regime")
    from ..functions.special import t_two_sided

    a, b = groups
    sa, sb = a["v"] / a["n"], b["v"] / b["n"]
    t = (a["m"] - b["m"]) / math.sqrt(sa + sb) if sa + sb > 0 else None
    dof = (sa + sb) ** 2 / (sa**2 / (a["n"] - 1) + sb**2 / (b["n"] - 1)) if sa + sb > 0 else None
    row = (str(a[0]), str(b[0]), a["m"], b["m"], a["n"], b["n"], t, t_two_sided(t, dof), a["m"] - b["m"])
    return df.sparkSession.createDataFrame([row], "regime_a string, regime_b string, mean_a double, mean_b double, n_a long, n_b long, t_stat double, p_value double, difference double")


def ols_one_sided(df: DataFrame, keys: list[str], x: str, y: str, sign: str) -> DataFrame:
    """(keys, n, slope, corr, t_ols, p_two_sided, p_one_sided, sign_matches): slope test in a direction named beforehand."""
    m = df.groupBy(*keys, sign).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("corr"))
    m = m.withColumn("t_ols", F.when(F.abs("corr") < 1, F.col("corr") * F.sqrt((F.col("n") - 2) / (1 - F.col("corr") * F.col("corr")))))
    dof = (F.col("n") - 2).cast("double")
    return m.withColumns({"p_two_sided": p_two_sided("t_ols", dof), "p_one_sided": p_upper(F.col("t_ols") * F.col(sign), dof), "sign_matches": F.signum("slope") == F.signum(F.col(sign).cast("double"))})


def benjamini_hochberg(df: DataFrame, p: str = "p", q: float = 0.10, among: Column | None = None) -> DataFrame:
    """``df`` with ``rejected``: the step-up rule at rate ``q`` over the p-values known (and ``among``).

    ``df`` holds a row for each test.  A p-value's rank is the number of tests
    at or below it: p-values are counted once each and dealt by range, the
    ranges' exact counts, a slim table, give what stands before each range.
    No task sees all tests.
    """
    counts = F.col(p).isNotNull() if among is None else F.col(p).isNotNull() & F.coalesce(among, F.lit(False))
    df = df.withColumn("__in", counts)
    each = df.where("__in").groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    each = cut(each.repartitionByRange("__p").withColumn("__range", F.spark_partition_id()))
    held = each.groupBy("__range").agg(F.sum("__n").alias("__held"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("__range"), F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__before"), F.sum("__held").over(Window.partitionBy()).alias("__m"))
    inside = Window.partitionBy("__range").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.withColumn("__k", F.sum("__n").over(inside)).join(F.broadcast(held), "__range").withColumn("__k", F.col("__before") + F.col("__k"))
    last = ranked.agg(F.max(F.when(F.col("__p") <= F.col("__k") / F.col("__m") * q, F.col("__p"))).alias("__cut"))
    return df.crossJoin(F.broadcast(last)).withColumn("rejected", F.coalesce(F.col("__in") & (F.col(p) <= F.col("__cut")), F.lit(False))).drop("__in", "__cut")


def bonferroni(n: int, alpha: float = 0.05) -> float:
    return alpha / max(1, n)


def required_years(sharpe: float, alpha: float = 0.05) -> float:
    """Years of returns by which a Sharpe ratio differs from 0; endless at or below 0."""
    z = normal_quantile(1 - alpha / 2)
    return math.inf if sharpe <= 0 else z * z * (1 + sharpe * sharpe / 2) / (sharpe * sharpe)


def overlap_warning(horizon_bars: int, sampling_bars: int = 1) -> str | None:
    if horizon_bars <= sampling_bars:
        return None
    return f"returns of {horizon_bars} bars sampled every {sampling_bars} overlap: about {horizon_bars / sampling_bars:.0f} rows say what one does"


def every_nth(df: DataFrame, axis: Axis, n: int) -> DataFrame:
    """Every n-th row of a series, so that horizons of ``n`` rows do not overlap."""
    from ..functions.axis import number

    return number(df, axis, "__pos").where(F.col("__pos") % n == 0).drop("__pos")
