"""Exponentially weighted means over series of any length.

``y = (1-a) y' + a x`` is an affine map of what came before, and such maps
compose.  Rows are dealt to chunks of positions; inside a chunk the weighted
sum is a plain running sum of rescaled terms, the chunks' ends are chained
over a slim table (a row for each chunk), and each row adds what its chunk
was handed.  No task needs a whole series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.axis import Axis, number


def _chunk(alpha: float) -> int:
    """Rows of a chunk, so that rescaled terms stay below about 1e9."""
    return max(2, min(1024, int(math.log(1e9) / -math.log1p(-alpha))))


def _depth(alpha: float, size: int) -> int:
    """Chunks after which what was handed on is below the last bit of a double."""
    return max(2, math.ceil(60 * math.log(2) / (-math.log1p(-alpha) * size)) + 1)


def _chained(decay: float):
    return lambda s, e: s * F.lit(decay) + e


def scan(df: DataFrame, axis: Axis, terms: dict[str, tuple[Column, float]], pos: str | None = None) -> DataFrame:
    """``df`` with, for each (x, alpha), the sum of (1-alpha)**k times x of k rows before.

    Null terms count as 0.  All terms share one pass; ``pos`` names the rows'
    positions where they are known already.
    """
    if not all(0 < a < 1 for _, a in terms.values()):
        raise ValueError("alpha must be between 0 and 1")
    size = min(_chunk(a) for _, a in terms.values())
    df = number(df, axis, "__pos") if pos is None else df.withColumn("__pos", F.col(pos))
    df = df.withColumn("__c", F.floor(F.col("__pos") / size)).withColumn("__j", F.col("__pos") % size)
    j = F.col("__j").cast("double")
    x = [(F.coalesce(c, F.lit(0.0)), 1 - a) for c, a in terms.values()]
    ends = df.groupBy(*axis.keys, "__c").agg(*(F.sum(c * F.pow(F.lit(k), size - 1 - j)).alias(f"__e{i}") for i, (c, k) in enumerate(x)))
    # every chunk but the last is full, so what a chunk hands on decays by a fixed factor for each later chunk
    chain = []
    for i, (_, a) in enumerate(terms.values()):
        before = Window.partitionBy(*axis.keys).orderBy("__c").rowsBetween(-_depth(a, size), -1)
        chain.append(F.aggregate(F.collect_list(f"__e{i}").over(before), F.lit(0.0), _chained((1 - a) ** size)).alias(f"__in{i}"))
    handed = ends.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(axis.keys)), F.col("__c").alias("__d"), *chain)
    same = F.col("__c") == F.col("__d")
    for i, k in enumerate(axis.keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*axis.keys, "__c").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(handed, same)
    sums = {name: F.sum(c * F.pow(F.lit(k), -j)).over(inside) * F.pow(F.lit(k), j) + F.col(f"__in{i}") * F.pow(F.lit(k), j + 1) for i, (name, (c, k)) in enumerate(zip(terms, x, strict=True))}
    gone = ["__pos", "__c", "__j", "__d", *(f"__k{i}" for i in range(len(axis.keys))), *(f"__in{i}" for i in range(len(terms)))]
    return out.withColumns(sums).drop(*gone)


def ewm_recursive(df: DataFrame, axis: Axis, columns: dict[str, str], alpha: float, first: Column | None = None, pos: str | None = None) -> DataFrame:
    """``y0 = x0, y = (1-alpha) y' + alpha x`` of each column from its first not-null value on; null where x is.

    ``first`` marks the rows of the first values where that is known; else
    they are looked up.  Columns may be null before their first value only.
    """
    seeds = [first] * len(columns)
    if first is None:
        starts = df.groupBy(*axis.keys).agg(*(F.min(F.when(F.col(x).isNotNull(), F.col(axis.ts))).alias(f"start_{i}__") for i, x in enumerate(columns.values())))
        df = df.join(starts, list(axis.keys), "left")
        seeds = [F.col(axis.ts) == F.col(f"start_{i}__") for i in range(len(columns))]
    terms = {into: (F.when(s, F.col(x)).otherwise(F.col(x) * alpha), alpha) for s, (into, x) in zip(seeds, columns.items(), strict=True)}
    out = scan(df, axis, terms, pos)
    return out.withColumns({into: F.when(F.col(x).isNotNull(), F.col(into)) for into, x in columns.items()}).drop(*(f"start_{i}__" for i in range(len(columns))))


def ewm_mean(df: DataFrame, axis: Axis, columns: dict[str, tuple[str, float]], pos: str | None = None) -> DataFrame:
    """Normalised means of (column, halflife); a null repeats the last value, before the first there is none.

    A value 60 halvings old weighs nothing any more.
    """
    if any(h <= 0 for _, h in columns.values()):
        raise ValueError("halflife must be above 0")
    terms = {}
    for i, (into, (x, h)) in enumerate(columns.items()):
        alpha = 1 - math.exp(-math.log(2) / h)
        terms[into] = (F.col(x), alpha)
        terms[f"weight_{i}__"] = (F.when(F.col(x).isNotNull(), 1.0).otherwise(0.0), alpha)
    out = scan(df, axis, terms, pos)
    out = out.withColumns({into: F.when(F.col(f"weight_{i}__") > 1e-300, F.col(into) / F.col(f"weight_{i}__")) for i, into in enumerate(columns)})
    return out.drop(*(f"weight_{i}__" for i in range(len(columns))))
