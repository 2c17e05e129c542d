"""Isotonic regression for many groups at once.

Equal predictions are one weighted knot.  Knots are dealt by ranges of group
and prediction; inside a range neighbours that fall are pooled, which leaves a
block for each pool.  Pooling is mergeable: the pools of all ranges, put one
after another and pooled again, are those of the whole group.  So a group of
any length is fitted by many tasks, and only its pools meet in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import held_upto

PARTS = ("lo", "hi", "w", "s")
KINDS = T.StructType([T.StructField(c, T.DoubleType()) for c in PARTS])


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows (lo, hi, w, s) of increasing means from sorted blocks: blocks that do not rise above the one before are pooled with it."""
    out: list[list[float]] = []
    for row in zip(lo.tolist(), hi.tolist(), w.tolist(), s.tolist(), strict=True):
        block = list(row)
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            last = out.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        out.append(block)
    return np.array(out).reshape(-1, 4)


def _pools(keys: int):
    """Pools of runs of equal keys of a sorted range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, schema = None, [], None

        def flush() -> pa.RecordBatch:
            m = pool(*np.concatenate(rows).T)
            same = [pa.array([v] * len(m), schema.field(k).type) for k, v in enumerate(key)]
            return pa.RecordBatch.from_arrays([*same, *(pa.array(m[:, k]) for k in range(4))], names=schema.names)

        for b in batches:
            schema = b.schema
            own = list(zip(*(b.column(k).to_pylist() for k in range(keys)), strict=True)) if keys else [()] * len(b)
            values = np.stack([b.column(keys + k).to_numpy(zero_copy_only=False) for k in range(4)], 1)
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if key is not None and own[i] != key:
                    yield flush()
                    rows = []
                key = own[i]
                rows.append(values[i:j])
                if sum(map(len, rows)) > 1 << 20:
                    rows = [pool(*np.concatenate(rows).T)]
        if rows:
            yield flush()

    return run


def fit_isotonic(df: DataFrame, keys: list[str], prediction: str, realized: str, min_rows: int = 50) -> DataFrame:
    """(keys, rows, xs, ys): the increasing map that is nearest to ``realized``, as its knots, for each group.

    Rows without prediction or outcome do not count; a group of fewer than
    ``min_rows`` others has null knots.
    """
    known = df.where(F.col(prediction).isNotNull() & F.col(realized).isNotNull())
    own = [F.col(k) for k in keys]
    x = F.col(prediction).cast("double")
    knots = known.groupBy(*own, x.alias("lo")).agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum(F.col(realized).cast("double")).alias("s"))
    knots = knots.select(*keys, "lo", F.col("lo").alias("hi"), "w", "s")
    ranged = knots.repartitionByRange(*keys, "lo").sortWithinPartitions(*keys, "lo")
    schema = T.StructType([*knots.select(*keys).schema.fields, *KINDS.fields])
    pools = ranged.mapInArrow(_pools(len(keys)), schema)
    fitted = T.StructType([*knots.select(*keys).schema.fields, T.StructField("rows", T.LongType()), T.StructField("xs", T.ArrayType(T.DoubleType())), T.StructField("ys", T.ArrayType(T.DoubleType()))])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("lo")
        m = pool(*(t.column(c).to_numpy() for c in PARTS))
        ends = np.stack((m[:, 0], m[:, 1]), 1)
        use = np.stack((np.ones(len(m), bool), m[:, 0] != m[:, 1]), 1)
        ys = np.repeat((m[:, 3] / m[:, 2])[:, None], 2, 1)
        n = int(m[:, 2].sum())
        enough = n >= min_rows
        cols = [t.column(k).slice(0, 1) for k in keys]
        knots = [pa.array([v[use].tolist() if enough else None], pa.list_(pa.float64())) for v in (ends, ys)]
        return pa.table([*cols, pa.array([n]), *knots], names=[*keys, "rows", "xs", "ys"])

    if keys:
        return pools.groupBy(*keys).applyInArrow(merge, fitted)
    return pools.groupBy(F.lit(0).alias("__all")).applyInArrow(merge, fitted)


def interpolate(xs: str, ys: str, at: str) -> Column:
    """The value at ``at`` of the line through knots, held at its ends; ``at`` itself where there are no knots."""
    k = held_upto(xs, at)
    inside = f"get({ys}, k - 1) + ({at} - get({xs}, k - 1)) * (get({ys}, k) - get({ys}, k - 1)) / (get({xs}, k) - get({xs}, k - 1))"
    found = f"element_at(transform(array({k}), k -> if(k = 0, get({ys}, 0), if(k >= size({xs}), get({ys}, k - 1), {inside}))), 1)"
    return F.expr(f"if({at} is null or {xs} is null, {at}, {found})")
