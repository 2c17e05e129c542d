"""Ordered series in unordered tables.

An ``Axis`` names the key columns of a series and what orders it; every
positional operator builds its windows from one.  Series are few and long, so
a window over a whole series would leave a large cluster idle.  ``number``
gives rows their exact position in two levels, and ``in_chunks`` runs any
operator of bounded memory on chunks of positions that overlap by a halo.
``running`` gives sums, products, maxima and last values of all rows up to
each one from those of spans of time and a slim table of what spans hand on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

CHUNK = 1 << 18
GRAIN = "month"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Axis:
    """Key columns of a series, its time column, and what breaks ties of time."""

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    tie: tuple[str, ...] = ()

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts, *self.tie)

    @property
    def wall(self) -> WindowSpec:
        """All rows up to this one."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def trailing(self, n: int, end: int = 0) -> WindowSpec:
        """``n`` rows that end ``-end`` rows before this one."""
        return self.ordered.rowsBetween(end - n + 1, end)

    def lag(self, x: str | Column, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.ordered)

    def lead(self, x: str | Column, n: int = 1) -> Column:
        return F.lead(col(x), n).over(self.ordered)

    def rolling(self, agg: Callable[[Column], Column], x: str | Column, n: int, least: int | None = None, end: int = 0) -> Column:
        """``agg`` over ``n`` trailing rows; null unless ``least`` (by default all) of them are not null."""
        w, x = self.trailing(n, end), col(x)
        return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def span_of(df: DataFrame, axis: Axis, grain: str) -> Column:
    """The span that a row stands in: a ``grain`` of time, or CHUNK values of a whole-number order."""
    if isinstance(df.schema[axis.ts].dataType, T.IntegralType):
        return F.floor(F.col(axis.ts) / CHUNK)
    return F.date_trunc(grain, F.col(axis.ts))


def number(df: DataFrame, axis: Axis, into: str = "pos", grain: str = "day") -> DataFrame:
    """``df`` with each row's position in its series, from 0.

    Rows are ranked inside spans of ``grain``; the spans' exact counts, a slim
    table, give what stands before each span.  No task sees a whole series.
    Rows without time stand first.
    """
    df = df.withColumn("__span", span_of(df, axis, grain))
    counts = df.groupBy(*axis.keys, "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*axis.keys).orderBy(F.col("__span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(axis.keys)), F.col("__span").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*axis.keys, "__span").orderBy(F.col(axis.ts).asc_nulls_first(), *axis.tie)
    same = F.col("__span").eqNullSafe(F.col("__s"))
    for i, k in enumerate(axis.keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    ranked = df.withColumn("__r", F.row_number().over(inside) - 1)
    return ranked.join(starts, same).withColumn(into, (F.col("__before") + F.col("__r")).cast("long")).drop("__span", "__r", "__s", "__before", *(f"__k{i}" for i in range(len(axis.keys))))


def in_chunks(df: DataFrame, axis: Axis, op: Callable[[DataFrame, Axis], DataFrame], back: int, ahead: int = 0, size: int = CHUNK, keep: str | None = None) -> DataFrame:
    """``op(df, axis)`` for an operator that looks ``back`` rows behind and ``ahead`` rows before it.

    Rows near a chunk's edge are dealt to the neighbour as well, so every row
    finds its whole neighbourhood inside its own chunk; such guests are left
    out of the result.  Every row of a series is used, whatever its length.
    """
    if max(back, ahead) > size:
        raise ValueError(f"a halo of {max(back, ahead)} rows does not fit chunks of {size}")
    df = number(df, axis, "__pos")
    own, at = F.floor(F.col("__pos") / size), F.col("__pos") % size
    homes = [F.struct(own.alias("chunk"), F.lit(False).alias("guest"))]
    if back:
        homes.append(F.when(at >= size - back, F.struct((own + 1).alias("chunk"), F.lit(True).alias("guest"))))
    if ahead:
        homes.append(F.when((at < ahead) & (own > 0), F.struct((own - 1).alias("chunk"), F.lit(True).alias("guest"))))
    dealt = df.withColumn("__home", F.explode(F.filter(F.array(*homes), lambda h: h.isNotNull())))
    dealt = dealt.select(*df.columns, F.col("__home.chunk").alias("__chunk"), F.col("__home.guest").alias("__guest"))
    done = op(dealt, Axis((*axis.keys, "__chunk"), "__pos"))
    done = done.where(~F.col("__guest")).drop("__chunk", "__guest")
    return done.withColumnRenamed("__pos", keep) if keep else done.drop("__pos")


def rolling_extremes(df: DataFrame, axis: Axis, into: dict[str, tuple[str, str]], n: int, least: int | None = None) -> DataFrame:
    """``df`` with ("min" or "max", x) over ``n`` trailing rows; null unless ``least`` (by default all) of them are not null.

    A bounded frame of a minimum costs Spark n steps a row.  Here rows stand in
    blocks of n: a window ends in one block and starts in it or the one
    before, so its extreme is that of the block's head up to the row and of
    the tail of the block before, both running.  Work for a row does not
    depend on n.
    """
    least = n if least is None else least
    keys, order = list(axis.keys), [axis.ts, *axis.tie]
    known = {f"__n_{x}": F.count(x).over(axis.wall) for _, x in into.values()}
    df = df.withColumn("__row", F.row_number().over(axis.ordered) - 1).withColumns(known)
    df = df.withColumn("__block", F.floor(F.col("__row") / n))
    head = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tail = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    how = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
    df = df.withColumns({f"__h_{c}": how[kind][0](x).over(head) for c, (kind, x) in into.items()})
    df = df.withColumns({f"__t_{c}": how[kind][0](x).over(tail) for c, (kind, x) in into.items()})
    out = {}
    for c, (kind, x) in into.items():
        held = F.col(f"__n_{x}") - F.coalesce(F.lag(f"__n_{x}", n).over(axis.ordered), F.lit(0))
        out[c] = F.when(held >= least, how[kind][1](F.col(f"__h_{c}"), F.lag(f"__t_{c}", n - 1).over(axis.ordered)))
    return df.withColumns(out).drop("__row", "__block", *known, *(f"__{p}_{c}" for p in "ht" for c in into))


def trailing_below(df: DataFrame, axis: Axis, x: str, n: int, into: str) -> DataFrame:
    """``df`` with how many of the ``n`` trailing rows hold less than the row's own ``x``; nulls are below nothing and have none below.

    Values become ranks, and a merge-sort tree over a series counts the
    smaller ones before any row: log2 of the series' length lookups a row,
    whatever n is.  Use it inside ``in_chunks``, which bounds the series.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.LongType())])
    order = [axis.ts, *axis.tie]

    def count(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        v = t.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False)
        return t.append_column(into, pa.array(smaller_trailing(v, n)))

    return df.groupBy(*axis.keys).applyInArrow(count, schema)


def smaller_trailing(v: np.ndarray, n: int) -> np.ndarray:
    """For each i how many of v[i-n+1 .. i] are below v[i]; NaN is below nothing."""
    m = len(v)
    rank = np.full(m, m, np.int64)
    real = ~np.isnan(v)
    rank[real] = np.unique(v[real], return_inverse=True)[1]
    upto = np.arange(m)

    def before(end: np.ndarray) -> np.ndarray:
        """How many of the first ``end`` values are below each row's own."""
        got = np.zeros(m, np.int64)
        for k in range(int(m).bit_length()):
            here = (end >> k) & 1 == 1  # a sorted block of 2**k values ends where the higher bits of ``end`` do
            if here.any():
                block = (end[here] >> (k + 1)) << 1
                at = np.searchsorted(levels[k], block * (m + 1) + rank[here])
                got[here] += at - (block << k)
        return got

    levels = [np.sort((upto >> k) * (m + 1) + rank) for k in range(int(m).bit_length())]
    below = before(upto) - before(np.maximum(upto - n + 1, 0))
    return np.where(real, below, 0)


def hand_on(df: DataFrame, axis: Axis, ends: dict[str, Column], chain: Callable[[WindowSpec, WindowSpec], dict[str, Column]]) -> DataFrame:
    """``df`` (with __span) joined with what its span is handed by those before.

    ``ends`` sums a span up into a row; ``chain`` gets that slim table's
    windows over the spans before and in order of spans, and says what is
    handed on in columns that start with __in.
    """
    slim = df.groupBy(*axis.keys, "__span").agg(*(v.alias(k) for k, v in ends.items()))
    order = Window.partitionBy(*axis.keys).orderBy(F.col("__span").asc_nulls_first())
    for k, v in chain(order.rowsBetween(Window.unboundedPreceding, -1), order).items():
        slim = slim.withColumn(k, v)
    handed = slim.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(axis.keys)), F.col("__span").alias("__d"), *(c for c in slim.columns if c.startswith("__in")))
    same = F.col("__span").eqNullSafe(F.col("__d"))
    for i, k in enumerate(axis.keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(handed, same).drop("__d", *(f"__k{i}" for i in range(len(axis.keys))))


def in_span(axis: Axis) -> WindowSpec:
    """The rows of a series' span, in order."""
    return Window.partitionBy(*axis.keys, "__span").orderBy(F.col(axis.ts).asc_nulls_first(), *axis.tie)


def running(df: DataFrame, axis: Axis, into: dict[str, tuple[str, Column]], grain: str = GRAIN) -> DataFrame:
    """``df`` with, for each (kind, x), the sum, product, max or last known value of x over all rows up to this one, or x of the row before ("prev").

    No task sees more of a series than a ``grain`` of time.
    """
    whole = {"sum": F.sum, "product": F.product, "max": F.max}
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "product": lambda a, b: F.coalesce(a * b, a, b), "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}
    df = df.withColumn("__span", span_of(df, axis, grain)).withColumns({f"__x{i}": x for i, (_, x) in enumerate(into.values())})
    kinds = [(i, name, kind, F.col(f"__x{i}")) for i, (name, (kind, _)) in enumerate(into.items())]
    at = F.struct(axis.ts, *axis.tie)
    known = {"last": lambda x: F.max_by(x, F.when(x.isNotNull(), at)), "prev": lambda x: F.max_by(x, at)} | whole
    over = whole | {"last": lambda x: F.last(x, ignorenulls=True)}

    def chain(before: WindowSpec, order: WindowSpec) -> dict[str, Column]:
        return {f"__in{i}": F.lag(f"__e{i}").over(order) if kind == "prev" else over[kind](F.col(f"__e{i}")).over(before) for i, _, kind, _ in kinds}

    df = hand_on(df, axis, {f"__e{i}": known[kind](x) for i, _, kind, x in kinds}, chain)
    order = in_span(axis)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for i, name, kind, x in kinds:
        handed = F.col(f"__in{i}")
        out[name] = F.when(F.row_number().over(order) == 1, handed).otherwise(F.lag(x).over(order)) if kind == "prev" else join[kind](handed, over[kind](x).over(upto))
    return df.withColumns(out).drop("__span", *(f"__x{i}" for i, *_ in kinds), *(f"__in{i}" for i, *_ in kinds))
