"""Isotonic maps by group, and models that pass through one fold by fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.functions.axis import Axis
from tidemark.operators import models
from tidemark.operators.isotonic import fit_isotonic, interpolate, pool

AXIS = Axis()


def isotonic_of(p, y):
    """Fitted values at the distinct predictions, by the max-min formula."""
    x = np.unique(p)
    w = np.array([(p == v).sum() for v in x], float)
    s = np.array([y[p == v].sum() for v in x])
    cw, cs = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(s)))
    mean = lambda a, b: (cs[b + 1] - cs[a]) / (cw[b + 1] - cw[a])
    return x, np.array([max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))])


def test_pools_of_parts_pool_to_the_whole():
    rng = np.random.default_rng(0)
    s, w = rng.normal(size=200), rng.integers(1, 4, 200).astype(float)
    x = np.arange(200.0)
    whole = pool(x, x, w, s)
    for cut in (1, 17, 100, 199):
        parts = np.concatenate([pool(x[:cut], x[:cut], w[:cut], s[:cut]), pool(x[cut:], x[cut:], w[cut:], s[cut:])])
        np.testing.assert_allclose(pool(*parts.T), whole)
    assert (np.diff(whole[:, 3] / whole[:, 2]) > 0).all() and pool(*np.zeros((4, 0))).shape == (0, 4)


def test_maps_by_group_against_the_formula(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(rng.integers(0, 60)) / 10, float(v)) for g, n in (("a", 150), ("b", 80), ("c", 10)) for v in rng.normal(size=n)]
    rows += [("a", None, 1.0), ("b", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, p double, y double").repartition(5)
    fitted = fit_isotonic(df, ["g"], "p", "y")
    assert {r["g"]: r["rows"] for r in fitted.collect()} == {"a": 150, "b": 80, "c": 10}
    asked = spark.createDataFrame([(g, float(x)) for g in "abc" for x in (-5, 0.05, 1.23, 3.3, 5.9, 99)] + [("a", None)], "g string, p double")
    got = asked.join(fitted, "g").select("g", "p", interpolate("xs", "ys", "p").alias("c")).collect()
    for r in got:
        if r["p"] is None or r["g"] == "c":  # too few rows: as it is
            assert r["c"] == r["p"]
            continue
        mine = [(p, y) for g, p, y in rows if g == r["g"] and p is not None and y is not None]
        x, fit = isotonic_of(*np.array(mine).T)
        assert r["c"] == pytest.approx(np.interp(r["p"], x, fit))


def dataset(spark, n, seed=5, symbols=("a", "b")):
    out = []
    for k, s in enumerate(symbols):
        rng = np.random.default_rng(seed + k)
        f = rng.normal(size=n)
        out.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "f_a": f, "y": 0.001 * f + rng.normal(0, 0.003, n)}))
    return models.with_positions(spark.createDataFrame(pd.concat(out)), AXIS), pd.concat(out)


@pytest.mark.parametrize("mode", ["expanding", "rolling"])
def test_calibrated_model_holds_out_a_chronological_slice(spark, mode):
    df, plain = dataset(spark, 520)
    split = models.Splitter(200, 60, 2, mode, step=47)
    model = models.Calibrated(models.Slope("f_a", "m"))
    got = model.predict(models.test_rows(df, split), model.fit(df, AXIS, split), AXIS).select("symbol", "fold", "pos", "prediction").collect()
    assert len(got) == 2 * sum(60 for _ in range(split.count(520)))
    want = {}
    for s, p in plain.groupby("symbol"):
        f, y = p["f_a"].to_numpy(), p["y"].to_numpy()
        for k in range(split.count(520)):
            lo, hi = (k * 47 if mode == "rolling" else 0), 200 + k * 47
            mid = hi - int((hi - lo) * 0.3)
            slope = np.cov(f[lo:mid], y[lo:mid], ddof=1)[0, 1] / f[lo:mid].var()
            x, fit = isotonic_of(slope * f[mid:hi], y[mid:hi])
            for pos in range(hi + 2, hi + 62):
                want[s, k, pos] = np.interp(slope * f[pos], x, fit)
    assert {(r["symbol"], r["fold"], r["pos"]) for r in got} == want.keys()
    np.testing.assert_allclose([r["prediction"] for r in got], [want[r["symbol"], r["fold"], r["pos"]] for r in got], atol=1e-12)


def test_short_window_skips_calibration_rather_than_crippling_fit(spark):
    df, plain = dataset(spark, 300, symbols=("a",))
    split = models.Splitter(100, 40, 1, "expanding", step=40)  # holds back 30, 42, 54 and 66 rows
    base = models.Slope("f_a", "m")
    model = models.Calibrated(base)
    params = {r["fold"]: r for r in model.fit(df, AXIS, split).collect()}
    alone = {r["fold"]: r["slope"] for r in base.fit(df, AXIS, split).collect()}
    assert [params[k]["__x"] is None for k in sorted(params)] == [True, True, False, False]
    assert all(params[k]["slope"] == pytest.approx(alone[k]) for k in (0, 1)) and params[2]["slope"] != pytest.approx(alone[2])
    out = model.predict(models.test_rows(df, split), model.fit(df, AXIS, split), AXIS)
    assert out.where("prediction is null").count() == 0


def test_skilless_predictions_collapse(spark):
    rng = np.random.default_rng(3)
    known = spark.createDataFrame(pd.DataFrame({"prediction": rng.normal(size=600), "y": rng.normal(0, 0.001, 600)}))
    out = models.isotonic(spark, known, known).select(F.stddev_samp("calibrated"), F.stddev_samp("y")).first()
    assert out[0] < 0.2 * out[1]
    few = models.isotonic(spark, known.limit(3), known.limit(3)).collect()
    assert all(r["calibrated"] == r["prediction"] for r in few)


def test_share_is_validated():
    for share in (0.0, 1.0):
        with pytest.raises(ValueError):
            models.Calibrated(models.Ridge(), share)


def test_calibrated_ridge_runs_in_a_backtest(spark):
    from tidemark.plans.backtest import run_backtest

    df, _ = dataset(spark, 420)
    data = df.drop("pos", "n").withColumn("market", F.lag("y").over(AXIS.ordered))
    run = run_backtest(data, AXIS, models.Splitter(200, 60), {"calibrated_ridge": models.BASELINES["calibrated_ridge"]}, vol_window=20)
    assert {r["symbol"] for r in run.net.collect()} == {"a", "b"}
