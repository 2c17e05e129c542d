"""Estimators without a closed form, fitted for every series and fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.functions.axis import Axis
from tidemark.operators import models
from tidemark.plans.backtest import run_backtest

AXIS = Axis()
SPLIT = models.Splitter(120, 40, 1)


def estimators():
    """Classes that travel to the tasks by value, as the tests' module is not there."""

    class Neighbours:
        """The mean target of the five rows that are nearest."""

        def fit(self, x, y):
            self.x, self.y = x, y
            return self

        def predict(self, x):
            d = ((x[:, None] - self.x[None]) ** 2).sum(2)
            return self.y[np.argsort(d, axis=1, kind="stable")[:, :5]].mean(1)

    class Fails:
        def fit(self, x, y):
            raise RuntimeError("no luck")

    class FailsLate(Neighbours):
        def predict(self, x):
            raise RuntimeError("not now")

    return Neighbours, Fails, FailsLate


Neighbours, Fails, FailsLate = estimators()


def panel(n=300):
    out = []
    for k, s in enumerate(("a", "b")):
        rng = np.random.default_rng(k)
        f = rng.normal(size=(n, 2))
        out.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "f_a": f[:, 0], "f_b": f[:, 1], "y": 0.002 * f[:, 0] + rng.normal(0, 0.003, n)}))
    return pd.concat(out)


@pytest.mark.parametrize(("mode", "window"), [("expanding", 10_000), ("expanding", 50), ("rolling", 10_000)])
def test_estimator_sees_its_folds_latest_rows_alone(spark, mode, window):
    p = panel()
    p.loc[(p["symbol"] == "a") & (p["ts"] == p["ts"].iloc[100]), "f_b"] = None
    df = models.with_positions(spark.createDataFrame(p).withColumn("f_b", F.when(~F.isnan("f_b"), F.col("f_b"))), AXIS)
    split = models.Splitter(120, 40, 1, mode)
    model = models.Estimator(Neighbours, ("f_a", "f_b"), window)
    got = model.predict(models.test_rows(df, split), model.fit(df, AXIS, split), AXIS).collect()
    assert len(got) == 2 * 40 * split.count(300)
    plain = {s: g for s, g in p.groupby("symbol")}
    for r in got:
        g = plain[r["symbol"]]
        hi = 120 + 40 * r["fold"]
        train = g.iloc[max(hi - window, 40 * r["fold"] if mode == "rolling" else 0) : hi].dropna()
        want = Neighbours().fit(train[["f_a", "f_b"]].to_numpy(), train["y"].to_numpy()).predict(g.iloc[[r["pos"]]][["f_a", "f_b"]].to_numpy())[0]
        assert r["prediction"] == pytest.approx(want)


def test_ensemble_survives_a_failing_member(spark):
    data = spark.createDataFrame(panel()).withColumn("market", F.lag("y").over(AXIS.ordered))
    members = {"near": models.Estimator(Neighbours, ("f_a",)), "wide": models.Estimator(Neighbours, ("f_a", "f_b")), "fails": models.Estimator(Fails, ("f_a",)), "late": models.Estimator(FailsLate, ("f_b",))}
    df = models.with_positions(data, AXIS)
    each = models.walk_forward(data, AXIS, SPLIT, members)
    assert each.where("model in ('fails', 'late') and prediction is not null").count() == 0
    assert each.where("model in ('near', 'wide') and prediction is null").count() == 0
    errors = {r["error"] for r in members["fails"].fit(df, AXIS, SPLIT).collect()}
    assert errors == {"RuntimeError: no luck"}
    stats = models.ensemble(each, ["symbol", "pos", "fold"])
    assert {r[0] for r in stats.select("n_members").distinct().collect()} == {2}
    run = run_backtest(data, AXIS, SPLIT, {}, vol_window=20, members=members)
    assert {(r["symbol"], r["model"]) for r in run.net.collect()} == {("a", "ensemble"), ("b", "ensemble")}


def test_members_from_any_estimator(spark):
    members = models.ensemble_members({"one": ["f_a"], "two": ["f_a", "f_b"], "none": []}, make=Neighbours)
    assert members.keys() == {"one", "two"} and all(isinstance(m, models.Estimator) for m in members.values())
    with pytest.raises(ValueError):
        models.ensemble_members({"one": ["f_a"]}, make=Neighbours)


def test_few_rows_predict_nothing(spark):
    df = models.with_positions(spark.createDataFrame(panel()), AXIS)
    model = models.Estimator(Neighbours, ("f_a",), least=1000)
    out = model.predict(models.test_rows(df, SPLIT), model.fit(df, AXIS, SPLIT), AXIS)
    assert out.count() > 0 and out.where("prediction is not null").count() == 0
