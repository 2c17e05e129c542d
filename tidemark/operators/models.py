"""Walk-forward folds and models fitted from sums.

A fold's training range is an interval of positions.  Rows are summed once
into the segments between all fold boundaries, and folds are running sums over
these; no row is copied for each fold.  Models that need only
moments (slopes, ridge) are fitted from those sums, for all folds and series
at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.axis import Axis, number
from ..functions.ranks import quantiles
from ..functions.scalar import divide
from ..session import cut
from .isotonic import fit_isotonic, interpolate


@dataclass(frozen=True)
class Splitter:
    """Training range, embargo and test range, moved on by ``step`` (by default a test range)."""

    train: int
    test: int
    embargo: int = 1
    mode: str = "expanding"
    step: int | None = None

    def __post_init__(self):
        if self.train < 1 or self.test < 1 or self.embargo < 0 or (self.step is not None and self.step < 1):
            raise ValueError("train, test and step must be above 0, embargo not below")
        if self.mode not in ("expanding", "rolling"):
            raise ValueError("mode is expanding or rolling")

    @property
    def by(self) -> int:
        return self.step or self.test

    def count(self, n: int) -> int:
        span = self.train + self.embargo + self.test
        return 0 if n < span else 1 + (n - span) // self.by

    def folds(self, sizes: DataFrame, n: str = "n") -> DataFrame:
        """``sizes`` with a row for each fold: fold, train_lo, train_hi, test_lo, test_hi (ends exclusive)."""
        span = self.train + self.embargo + self.test
        k = F.when(F.col(n) >= span, F.floor((F.col(n) - span) / self.by))
        start = F.col("fold") * self.by
        out = sizes.where(F.col(n) >= span).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), k))).withColumn("train_hi", start + self.train)
        out = out.withColumn("train_lo", F.lit(0).cast("long") if self.mode == "expanding" else start)
        return out.withColumn("test_lo", F.col("train_hi") + self.embargo).withColumn("test_hi", F.col("test_lo") + self.test)

    def first_training(self, pos: Column) -> Column:
        """The first fold that learns from a position."""
        return F.greatest(F.lit(0).cast("long"), F.floor((pos - self.train) / self.by) + 1)

    def training_folds(self, window: int, pos: str = "pos", n: str = "n") -> Column:
        """The folds that have a position among the latest ``window`` of their training range, as an array."""
        window = min(window, self.train) if self.mode == "rolling" else window
        first = Splitter.first_training(self, F.col(pos))
        last = F.least(F.floor((F.col(pos) - self.train + window) / self.by), F.floor((F.col(n) - (self.train + self.embargo + self.test)) / self.by))
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def test_folds(self, pos: str = "pos", n: str = "n") -> Column:
        """The folds that test a position, as an array."""
        at = F.col(pos) - (self.train + self.embargo)
        first = F.greatest(F.lit(0).cast("long"), F.floor((at - self.test) / self.by) + 1)
        last = F.least(F.floor(at / self.by), F.floor((F.col(n) - (self.train + self.embargo + self.test)) / self.by))
        return F.when((at >= 0) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class Held(Splitter):
    """The folds of a splitter that learn from all but the last ``share`` of their training range."""

    def __init__(self, of: Splitter, share: float):
        for k in ("train", "test", "embargo", "mode", "step"):
            object.__setattr__(self, k, getattr(of, k))
        object.__setattr__(self, "share", share)

    def held(self, fold: Column) -> Column:
        """Rows of a fold's training range that are held back."""
        size = F.lit(self.train) + (fold * self.by if self.mode == "expanding" else 0)
        return F.floor(size * self.share)

    def end(self, fold: Column) -> Column:
        """The first position that is held back."""
        return fold * self.by + self.train - self.held(fold)

    def first_training(self, pos: Column) -> Column:
        if self.mode == "rolling":
            return F.greatest(F.lit(0).cast("long"), F.floor((pos - (self.train - math.floor(self.train * self.share))) / self.by) + 1)
        # a range's end less its share is within one row of (1 - share) of it
        least = F.greatest(F.lit(0).cast("long"), F.floor(((pos - 1) / (1 - self.share) - self.train) / self.by))
        near = F.sequence(least, least + (math.ceil(2 / ((1 - self.share) * self.by)) + 2))
        return F.try_element_at(F.filter(near, lambda f: self.end(f) > pos), F.lit(1))

    def held_folds(self, pos: str = "pos", n: str = "n") -> Column:
        """The folds that hold a position back, as an array."""
        first = Splitter.first_training(self, F.col(pos))
        last = F.least(self.first_training(F.col(pos)) - 1, F.floor((F.col(n) - (self.train + self.embargo + self.test)) / self.by))
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def with_positions(df: DataFrame, axis: Axis) -> DataFrame:
    """``df`` with pos and the series' size n."""
    df = number(df, axis, "pos")
    return df.join(df.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias("n")), list(axis.keys))


def fold_sums(df: DataFrame, axis: Axis, splitter: Splitter, sums: dict[str, Column]) -> DataFrame:
    """(keys, fold, ...): each sum over the fold's training rows; ``df`` has pos and n.

    Rows are summed by the first fold that trains on them and, when rolling,
    by the first that no longer does.  A fold's sum is then a running sum over
    these slim segments, in fold order: no fold meets the segments of others.
    """
    keys = list(axis.keys)
    enter = splitter.first_training(F.col("pos"))
    seg = df.groupBy(*keys, enter.alias("fold")).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    if splitter.mode == "rolling":
        leave = F.floor(F.col("pos") / splitter.by) + 1
        seg = seg.unionByName(df.groupBy(*keys, leave.alias("fold")).agg(*((-F.sum(v)).alias(k) for k, v in sums.items())))
    folds = splitter.folds(df.groupBy(*keys).agg(F.max("n").alias("n"))).select(*keys, F.col("fold").cast("long").alias("fold"), *(F.lit(0.0).alias(k) for k in sums), F.lit(1).alias("__is"))
    rows = seg.withColumn("__is", F.lit(0)).unionByName(folds)
    until = Window.partitionBy(*keys).orderBy("fold", "__is").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, "fold", "__is", *(F.sum(k).over(until).alias(k) for k in sums)).where("__is = 1").drop("__is")


def test_rows(df: DataFrame, splitter: Splitter) -> DataFrame:
    """Rows of test ranges with their fold; ``df`` has pos and n."""
    return df.withColumn("fold", F.explode(splitter.test_folds()))


class Model(Protocol):
    """Fits all folds of all series at once and predicts their test rows."""

    name: str

    def fit(self, df: DataFrame, axis: Axis, splitter: Splitter) -> DataFrame: ...

    def predict(self, rows: DataFrame, params: DataFrame, axis: Axis) -> DataFrame: ...


@dataclass(frozen=True)
class BuyAndHold:
    """The mean size of the target, always long."""

    size: float = 1.0
    name: str = "buy_and_hold"

    def fit(self, df, axis, splitter):
        sums = fold_sums(df, axis, splitter, {"s": F.abs("y"), "m": F.when(F.col("y").isNotNull(), 1.0)})
        return sums.select(*axis.keys, "fold", (divide("s", "m") * self.size).alias("level"))

    def predict(self, rows, params, axis):
        return rows.join(params, [*axis.keys, "fold"]).withColumn("prediction", F.col("level")).drop("level")


@dataclass(frozen=True)
class RandomSignal:
    """A seeded coin, the same in each fold, times the mean size of the target."""

    seed: int = 0
    name: str = "random"

    def fit(self, df, axis, splitter):
        return BuyAndHold().fit(df, axis, splitter)

    def predict(self, rows, params, axis):
        within = F.row_number().over(Window.partitionBy(*axis.keys, "fold").orderBy("pos"))
        coin = F.when(F.xxhash64(F.lit(self.seed), within).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
        return rows.join(params, [*axis.keys, "fold"]).withColumn("prediction", coin * F.col("level")).drop("level")


@dataclass(frozen=True)
class Slope:
    """One feature's slope (sample covariance over population variance), without intercept."""

    feature: str = "f_mom_12"
    name: str = "naive_momentum"

    def fit(self, df, axis, splitter):
        x, y = F.col(self.feature), F.col("y")
        ok = x.isNotNull() & y.isNotNull()
        of = lambda c: F.when(ok, c)
        s = fold_sums(df, axis, splitter, {"m": of(F.lit(1.0)), "sx": of(x), "sy": of(y), "sxy": of(x * y), "sxx": of(x * x)})
        cov = divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("m"), F.col("m") - 1)
        var = F.col("sxx") / F.col("m") - F.pow(F.col("sx") / F.col("m"), 2)
        return s.select(*axis.keys, "fold", F.when(var > 1e-18, cov / var).otherwise(0.0).alias("slope"))

    def predict(self, rows, params, axis):
        return rows.join(params, [*axis.keys, "fold"]).withColumn("prediction", F.col("slope") * F.col(self.feature)).drop("slope")


@dataclass(frozen=True)
class Ridge:
    """Standardised ridge regression with intercept, from each fold's Gram matrix."""

    alpha: float = 1.0
    features: tuple[str, ...] = ()
    name: str = "ridge"

    def _names(self, df):
        return list(self.features) or [c for c in df.columns if c.startswith("f_")]

    def fit(self, df, axis, splitter):
        f = self._names(df)
        v = [F.lit(1.0), *(F.col(c) for c in f), F.col("y")]
        k = len(v)
        sums = fold_sums(df, axis, splitter, {f"g{i}_{j}": v[i] * v[j] for i in range(k) for j in range(i, k)})
        gram = sums.select(*axis.keys, "fold", F.array(*(f"g{i}_{j}" for i in range(k) for j in range(i, k))).alias("g"))
        schema = gram.select(*axis.keys, "fold").schema.add("beta", T.ArrayType(T.DoubleType()))
        alpha, names = self.alpha, [*axis.keys, "fold"]

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = np.triu_indices(k)
            for b in batches:
                out = []
                for g in b["g"]:
                    m = np.zeros((k, k))
                    m[at] = g
                    m = m + m.T - np.diag(np.diag(m))
                    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
                    c = m[1:, 1:] - n * np.outer(mean, mean)
                    sd = np.sqrt(np.maximum(np.diag(c)[:-1] / n, 0))
                    sd[sd < 1e-12] = 1.0  # a constant feature weighs nothing
                    z = c[:-1, :-1] / np.outer(sd, sd)
                    w = np.linalg.solve(z + alpha * np.eye(k - 2), c[:-1, -1] / sd) / sd
                    out.append([float(mean[-1] - w @ mean[:-1]), *map(float, w)])
                yield b[names].assign(beta=out)

        return gram.mapInPandas(solve, schema)

    def predict(self, rows, params, axis):
        f = self._names(rows)
        joined = rows.join(params, [*axis.keys, "fold"])
        y = F.col("beta")[0]
        for i, c in enumerate(f):
            y = y + F.col("beta")[i + 1] * F.col(c)
        return joined.withColumn("prediction", y).drop("beta")


@dataclass(frozen=True)
class Calibrated:
    """A model whose predictions pass through an isotonic map of its own, fold by fold.

    The model learns from the earlier part of a fold's training range and the
    map from the last ``share`` of it, never from a test row.  A fold whose
    last part has fewer than ``min_rows`` rows learns from all of it and has no
    map.
    """

    base: Model
    share: float = 0.3
    min_rows: int = 50
    name: str = "calibrated"

    def __post_init__(self):
        if not 0 < self.share < 1:
            raise ValueError("share must be above 0 and below 1")

    def fit(self, df, axis, splitter):
        keys = [*axis.keys, "fold"]
        early = Held(splitter, self.share)
        enough = early.held(F.col("fold")) >= self.min_rows
        params = self.base.fit(df, axis, early).where(enough).unionByName(self.base.fit(df, axis, splitter).where(~enough))
        params = cut(params)  # read for the maps and for the predictions
        last = df.withColumn("fold", F.explode(early.held_folds())).where(enough)
        maps = fit_isotonic(self.base.predict(last, params, axis), keys, "prediction", "y", self.min_rows)
        return params.join(maps.select(*keys, F.col("xs").alias("__x"), F.col("ys").alias("__y")), keys, "left")

    def predict(self, rows, params, axis):
        keys = [*axis.keys, "fold"]
        raw = self.base.predict(rows, params.drop("__x", "__y"), axis)
        return raw.join(params.select(*keys, "__x", "__y"), keys).withColumn("prediction", interpolate("__x", "__y", "prediction")).drop("__x", "__y")


@dataclass(frozen=True)
class Estimator:
    """Any estimator with fit(X, y) and predict(X) over NumPy arrays, fitted anew for every series and fold.

    ``make`` builds one; it travels to the tasks, and what it learnt travels
    to the test rows as bytes.  A fold's slice is the latest ``window`` rows of
    its training range, so a task holds that many however long the series is.
    Rows without a feature or target are not learnt from and get no prediction.  A fold whose
    estimator fails, or that has fewer than ``least`` rows, predicts null,
    which ensembles leave out; ``error`` in the parameters says why.
    """

    make: Callable[[], object]
    features: tuple[str, ...] = ()
    window: int = 10_000
    least: int = 2
    name: str = "estimator"

    def _names(self, df):
        return list(self.features) or [c for c in df.columns if c.startswith("f_")]

    def fit(self, df, axis, splitter):
        keys, names, make, least = [*axis.keys, "fold"], self._names(df), self.make, self.least
        slices = df.select(*axis.keys, "pos", "y", *names, F.explode(splitter.training_folds(self.window)).alias("fold"))
        schema = T.StructType([*slices.select(*keys).schema.fields, T.StructField("model", T.BinaryType()), T.StructField("error", T.StringType())])

        def learn(t: pa.Table) -> pa.Table:
            own = [t.column(k).slice(0, 1) for k in keys]
            t = t.select(["pos", "y", *names]).drop_null().sort_by("pos")
            model = error = None
            try:
                if len(t) < least:
                    raise ValueError(f"{len(t)} rows to learn from")
                e = make()
                e = e.fit(_matrix(t, names), t.column("y").to_numpy()) or e
                model = cloudpickle.dumps(e)
            except Exception as wrong:  # of the member, not of the run
                error = f"{type(wrong).__name__}: {wrong}"
            return pa.table([*own, pa.array([model], pa.binary()), pa.array([error], pa.string())], names=[*keys, "model", "error"])

        return slices.groupBy(*keys).applyInArrow(learn, schema)

    def predict(self, rows, params, axis):
        keys, names = [*axis.keys, "fold"], self._names(rows)
        schema = T.StructType([*rows.schema.fields, T.StructField("prediction", T.DoubleType())])

        def apply(t: pa.Table, learnt: pa.Table) -> pa.Table:
            out = np.full(len(t), np.nan)
            blob = learnt.column("model")[0].as_py() if len(learnt) else None
            x = _matrix(t, names)
            known = ~np.isnan(x).any(1)
            if blob is not None and known.any():
                try:
                    out[known] = cloudpickle.loads(blob).predict(x[known])
                except Exception:  # a member that cannot predict is left out
                    out[:] = np.nan
            return t.append_column("prediction", pa.array(out, from_pandas=True))

        return rows.groupBy(*keys).cogroup(params.select(*keys, "model").groupBy(*keys)).applyInArrow(apply, schema)


class Nearest:
    """The mean target of the ``k`` learnt rows with the nearest features; of equally near ones the earlier."""

    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, x: np.ndarray, y: np.ndarray) -> Nearest:
        self.x, self.y = x, y
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = [self.y[np.argsort(((self.x - row) ** 2).sum(1), kind="stable")[: self.k]].mean() for row in x]
        return np.array(out)


def _matrix(t: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names], 1) if names else np.zeros((len(t), 0))


BASELINES: dict[str, Model] = {"buy_and_hold": BuyAndHold(), "random": RandomSignal(), "naive_momentum": Slope(), "mean_reversion": Slope("f_z_close_96", "mean_reversion"), "ridge": Ridge(), "calibrated_momentum": Calibrated(Slope(), name="calibrated_momentum"), "calibrated_ridge": Calibrated(Ridge(), name="calibrated_ridge")}


def walk_forward(df: DataFrame, axis: Axis, splitter: Splitter, models: dict[str, Model]) -> DataFrame:
    """Test rows of every model and fold: the columns of ``df``, pos, fold, model, prediction.

    The rows are computed once, as every model reads them.
    """
    df = cut(with_positions(cut(df), axis))
    rows = test_rows(df, splitter)
    out = None
    for name, model in models.items():
        got = model.predict(rows, model.fit(df, axis, splitter), axis).withColumn("model", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def first_fold(predictions: DataFrame, axis: Axis) -> DataFrame:
    """Of rows that several folds test, the one of the first."""
    w = Window.partitionBy(*axis.keys, "model", "pos").orderBy("fold")
    return predictions.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def ensemble(members: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    """Mean, spread and agreement of the members' predictions of each row; failed (null) members are skipped."""
    m = members.where(F.col(prediction).isNotNull())
    stats = m.groupBy(*keys).agg(F.avg(prediction).alias("mean"), F.stddev_samp(prediction).alias("std"), F.percentile(prediction, 0.1).alias("p10"), F.percentile(prediction, 0.9).alias("p90"), F.count(F.lit(1)).alias("n_members"), F.count_if(F.col(prediction) > 0).alias("__up"), F.count_if(F.col(prediction) < 0).alias("__down"))
    agree = F.when(F.col("mean") > 0, F.col("__up")).when(F.col("mean") < 0, F.col("__down")).otherwise(F.lit(0)) / F.col("n_members")
    return stats.withColumn("agreement", agree).drop("__up", "__down")


def ensemble_members(feature_sets: dict[str, list[str]], alpha: float = 1.0, least: int = 2, make: Callable[[], object] | None = None, window: int = 10_000) -> dict[str, Model]:
    """A member for each feature set: ridge, or whatever estimator ``make`` builds."""
    if len(feature_sets) < least:
        raise ValueError(f"an ensemble needs at least {least} feature sets")
    return {k: Estimator(make, tuple(v), window, name=k) if make else Ridge(alpha, tuple(v), k) for k, v in feature_sets.items() if v}


def isotonic(spark: SparkSession, known: DataFrame, new: DataFrame, prediction: str = "prediction", realized: str = "y", min_rows: int = 50) -> DataFrame:
    """``new`` with ``calibrated``: an increasing map from predictions to returns, clipped outside.

    With fewer than ``min_rows`` known rows the prediction stays as it is.
    """
    fitted = fit_isotonic(known, [], prediction, realized, min_rows).select(F.col("xs").alias("__x"), F.col("ys").alias("__y"))
    # one row
    return new.join(F.broadcast(fitted), how="left").withColumn("calibrated", interpolate("__x", "__y", prediction)).drop("__x", "__y")


def calibration_split(df: DataFrame, share: float = 0.3, pos: str = "pos", end: str = "n") -> DataFrame:
    """``df`` with ``for_calibration``: the last ``share`` of each training range."""
    return df.withColumn("for_calibration", F.col(pos) >= F.col(end) - F.floor(F.col(end) * share))


def calibration_report(df: DataFrame, prediction: str, realized: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_pred, mean_actual, ratio) over quantile bins, closed on the right; equal edges are one."""
    df = df.where(F.col(prediction).isNotNull() & F.col(realized).isNotNull())
    names = [f"__q{i}" for i in range(bins + 1)]
    edges = quantiles(df, [], prediction, {c: i / bins for i, c in enumerate(names)}).select(F.array_distinct(F.array(*names)).alias("__e"))
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(0), F.expr(f"size(filter(__e, e -> e < {prediction})) - 1")))
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(prediction).alias("mean_pred"), F.avg(realized).alias("mean_actual"))
    return out.withColumn("ratio", divide("mean_actual", "mean_pred"))
