"""Exact ranks and quantiles of any number of groups, no task of which sees a whole group.

Rows become counts of distinct values, dealt by ranges of group and value.
The ranges' counts, a slim table, give what stands before each range; a window
inside a range gives the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut


def ranked(df: DataFrame, keys: list[str], x: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """(keys, x, here, below, all, sums): a row for each distinct value of a group: rows that have it, rows below it, rows of the group, and sums over the rows that have it.

    Rows without ``x`` do not count.
    """
    sums = sums or {}
    each = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("here"), *(v.alias(k) for k, v in sums.items()))
    each = cut(each.repartitionByRange(*keys, x).withColumn("__range", F.spark_partition_id()))
    held = each.groupBy(*keys, "__range").agg(F.sum("here").alias("__held"))
    whole = Window.partitionBy(*keys)
    held = held.withColumns({"__before": F.coalesce(F.sum("__held").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("__held").over(whole)})
    held = held.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__range").alias("__r"), "__before", "all")
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    out = each.withColumn("__in", F.coalesce(F.sum("here").over(inside), F.lit(0))).join(held, same)
    return out.select(*keys, x, "here", (F.col("__before") + F.col("__in")).alias("below"), "all", *sums)


def quantiles(df: DataFrame, keys: list[str], x: str, at: dict[str, float]) -> DataFrame:
    """(keys, a column for each share in ``at``): exact quantiles, linear between neighbours; groups without a value do not appear."""
    r = ranked(df, keys, x)
    place = {c: F.lit(float(p)) * (F.col("all") - 1) for c, p in at.items()}
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("here"))
    ends = [F.max(F.when(holds(f(k)), F.col(x))).alias(f"__{side}_{c}") for c, k in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = r.groupBy(*keys).agg(F.max("all").alias("all"), *ends)
    line = {c: F.col(f"__lo_{c}") + (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")) * (k - F.floor(k)) for c, k in place.items()}
    return found.select(*keys, *(v.alias(c) for c, v in line.items())).where(F.col(next(iter(at))).isNotNull()) if at else found.select(*keys)
