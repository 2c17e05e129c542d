"""Performance of return streams, and bootstrap intervals around it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.axis import GRAIN, Axis, hand_on, in_span, number
from ..functions.scalar import divide
from ..session import cut


def with_equity(df: DataFrame, axis: Axis, ret: str, also: dict[str, str] | None = None, grain: str = GRAIN) -> DataFrame:
    """``df`` with equity (product of 1 + r, nulls earn nothing) and drawdown from its peak.

    ``also`` names further columns whose value in the row before is wanted.
    Growth and peak of a span of time are its own, times the growth it is
    handed, so no task sees a whole series.
    """
    also = also or {}
    df = df.withColumn("__span", F.date_trunc(grain, F.col(axis.ts)))
    order = in_span(axis)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__g", F.product(F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0))).over(upto))
    df = df.withColumns({"__hi": F.max("__g").over(upto), "__lo": F.min("__g").over(upto)})
    at = F.struct(axis.ts, *axis.tie)
    ends = {"__eg": F.max_by("__g", at), "__ehi": F.max("__g"), "__elo": F.min("__g"), **{f"__e{i}": F.max_by(x, at) for i, x in enumerate(also.values())}}

    def chain(before, spans):
        last = {f"__in{i}": F.lag(f"__e{i}").over(spans) for i in range(len(also))}
        return {"__in_g": F.coalesce(F.product("__eg").over(before), F.lit(1.0)), "__peak": F.greatest(F.col("__in_g") * F.col("__ehi"), F.col("__in_g") * F.col("__elo")), "__in_p": F.max("__peak").over(before), **last}

    df = hand_on(df, axis, ends, chain)
    peak = F.greatest(F.col("__in_p"), F.col("__in_g") * F.col("__hi"), F.col("__in_g") * F.col("__lo"))
    df = df.withColumn("equity", F.col("__in_g") * F.col("__g")).withColumn("drawdown", F.col("equity") / peak - 1)
    lagged = {into: F.when(F.row_number().over(order) == 1, F.col(f"__in{i}")).otherwise(F.lag(x).over(order)) for i, (into, x) in enumerate(also.items())}
    return df.withColumns(lagged).drop("__span", "__g", "__hi", "__lo", "__in_g", "__in_p", *(f"__in{i}" for i in range(len(also))))


def sharpe(r: str, bars_per_year: int) -> Column:
    return divide(F.avg(r), F.stddev_samp(r)) * math.sqrt(bars_per_year)


def sortino(r: str, bars_per_year: int) -> Column:
    """Mean over the sample deviation of the negative returns."""
    return divide(F.avg(r), F.stddev_samp(F.when(F.col(r) < 0, F.col(r)))) * math.sqrt(bars_per_year)


def summarize(df: DataFrame, axis: Axis, ret: str, bars_per_year: int, position: str | None = None) -> DataFrame:
    """Ten figures for each series of returns; rows without return are left out."""
    df = df.where(F.col(ret).isNotNull())
    held = F.coalesce(F.col(position), F.lit(0.0)) if position else F.lit(None).cast("double")
    df = with_equity(df.withColumn("__p", held), axis, ret, {"__before": "__p"})
    df = df.withColumn("__t", F.abs(F.col("__p") - F.coalesce("__before", F.lit(0.0))))
    out = df.groupBy(*axis.keys).agg(
        F.count(F.lit(1)).alias("n_bars"), (F.max_by("equity", axis.ts) - 1).alias("total_return"), (F.stddev_samp(ret) * math.sqrt(bars_per_year)).alias("ann_vol"),
        sharpe(ret, bars_per_year).alias("sharpe"), sortino(ret, bars_per_year).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.sum("__t").alias("__turn"),
    )
    years = F.col("n_bars") / float(bars_per_year)
    out = out.withColumn("ann_return", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / years) - 1))
    out = out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("ann_return") / F.abs("max_drawdown")))
    out = out.withColumn("turnover", F.col("__turn") / years)
    return out.select(*axis.keys, "n_bars", "total_return", "ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "turnover")


def fold_spread(folds: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, mean, std, min, max) over folds."""
    long = folds.unpivot(keys, metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def sharpe_of(bars_per_year: int) -> Column:
    """The Sharpe ratio from a resample's number, sum and sum of squares."""
    mean = F.col("s1") / F.col("n")
    var = (F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1)
    return F.when(var > 1e-30, mean / F.sqrt(var)) * math.sqrt(bars_per_year)


#: What a stretch of returns r is summed up into: how rows are taken in, and how two stretches merge.
STATES = {"s1": (lambda r: F.sum(r), lambda a, b: a + b), "s2": (lambda r: F.sum(r * r), lambda a, b: a + b), "growth": (lambda r: F.product(1 + r), lambda a, b: a * b)}


def _stretches(ring: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, states) of ``ring`` (keys, pos, n, r, __len): the states of the ``__len`` returns from each position on.

    Positions stand in cells of that length.  A stretch is the tail of a cell
    and the head of the next, both running inside their cell, so no task needs
    more of a series than a cell: rows are dealt by cells, as the join that
    gave them n may have left a series in one task.
    """
    ring = ring.withColumn("__cell", F.floor(F.col("pos") / F.col("__len"))).repartition(*keys, "__cell")
    cell = Window.partitionBy(*keys, "__cell").orderBy("pos")
    head, tail = cell.rowsBetween(Window.unboundedPreceding, 0), cell.rowsBetween(0, Window.unboundedFollowing)
    r = F.col("r")
    heads = ring.select(*keys, (F.col("pos") - F.col("__len") + 1).alias("pos"), *(f(r).over(head).alias(f"__h_{c}") for c, (f, _) in STATES.items()))
    tails = ring.select(*keys, "pos", "n", "__len", *(f(r).over(tail).alias(f"__t_{c}") for c, (f, _) in STATES.items())).where("pos < n")
    both = tails.join(heads, [*keys, "pos"])
    alone = F.col("pos") % F.col("__len") == 0
    return both.select(*keys, "pos", *(F.when(alone, F.col(f"__t_{c}")).otherwise(merge(F.col(f"__t_{c}"), F.col(f"__h_{c}"))).alias(c) for c, (_, merge) in STATES.items()))


def bootstrap(df: DataFrame, axis: Axis, ret: str, statistics: dict[str, Column], block: int = 96, resamples: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(keys, <name>_lo, <name>_hi): circular block bootstrap intervals of statistics of n, s1, s2 (sums of r and its square) and growth (product of 1 + r).

    A resample merges the states of its blocks, which are known for every
    start, so it joins one row for each block drawn, not each return.  The
    last block is cut so that a resample is as long as the series.  Starts
    come from checksums of keys, resample, block and seed and do not depend on
    partitioning.  A series shorter than a block gives nulls.
    """
    keys = list(axis.keys)
    r = cut(number(df.where(F.col(ret).isNotNull()).select(*keys, axis.ts, F.col(ret).alias("r")), axis, "pos").select(*keys, "pos", "r"))
    n = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    r = r.join(n, keys).where(F.col("n") >= block)
    lengths = [F.struct(F.lit(False).alias("__cut"), F.lit(block).cast("long").alias("__len")), F.struct(F.lit(True).alias("__cut"), (F.col("n") % block).alias("__len"))]
    ring = r.withColumn("__as", F.explode(F.filter(F.array(*lengths), lambda x: x["__len"] > 0))).select("*", "__as.*").drop("__as")
    # rows are multiplied, not united: Spark 4.1 takes a union of two joins for dealt by their keys, then merges partitions of each join by itself, which tears cells apart
    ring = ring.withColumn("pos", F.explode(F.when(F.col("pos") < F.col("__len"), F.array("pos", F.col("pos") + F.col("n"))).otherwise(F.array("pos"))))
    stretches = _stretches(ring, [*keys, "__cut"])
    # a series holds as many blocks as a resample draws; they are dealt over a fixed number of tasks, as Spark would merge so few rows into one, which would then make all draws
    blocks = r.where(F.col("pos") % block == 0).select(*keys, "n", F.floor(F.col("pos") / block).alias("b")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "b")
    draws = blocks.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    name = F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys), "rep", "b", F.lit(seed)).cast("binary"))
    draws = draws.withColumn("pos", F.conv(F.substring(name, 1, 15), 16, 10).cast("long") % F.col("n")).withColumn("__cut", (F.col("b") + 1) * block > F.col("n"))
    # without the hint Spark takes draws for as small as the blocks they are exploded from and broadcasts them all
    got = draws.join(stretches.hint("merge"), [*keys, "pos", "__cut"]).groupBy(*keys, "rep").agg(F.max("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.product("growth").alias("growth"))
    got = got.select(*keys, *(v.alias(c) for c, v in statistics.items()))
    ends = [F.percentile(c, p).alias(f"{c}_{side}") for c in statistics for side, p in (("lo", alpha / 2), ("hi", 1 - alpha / 2))]  # of so many resamples a key
    return n.select(*keys).join(got.groupBy(*keys).agg(*ends), keys, "left")


def bootstrap_sharpe(df: DataFrame, axis: Axis, ret: str, bars_per_year: int, block: int = 96, resamples: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(keys, lo, hi): ``bootstrap`` of the Sharpe ratio."""
    out = bootstrap(df, axis, ret, {"sharpe": sharpe_of(bars_per_year)}, block, resamples, alpha, seed)
    return out.withColumnsRenamed({"sharpe_lo": "lo", "sharpe_hi": "hi"})


def report(gross: dict, net: dict, ci: tuple[float, float] | None = None) -> str:
    """Gross beside net, as text in columns of equal width."""
    names = [k for k in gross if isinstance(gross[k], (int, float)) or gross[k] is None]
    show = lambda v: "n/a" if v is None else f"{v:,}" if isinstance(v, int) else f"{v:.4f}"
    lines = [f"{'':<16}{'gross':>14}{'net':>14}"] + [f"{k:<16}{show(gross[k]):>14}{show(net.get(k)):>14}" for k in names]
    return "\n".join(lines + ([f"net Sharpe, 95 %: [{ci[0]:.3f}, {ci[1]:.3f}]"] if ci else []))
