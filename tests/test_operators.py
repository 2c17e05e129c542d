"""Operators against pandas, hand-made cases and the properties that causality asks for."""

import math
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.functions.axis import Axis, in_chunks, number
from tidemark.functions.special import incomplete_beta, t_two_sided
from tidemark.operators import asof, bars, calendar, costs, ewm, execution, features, macro, metrics, models, quality, scoring
from tidemark.plans import governance
from tidemark.sources import tables

AXIS = Axis()


def bar_frame(n=600, seed=0):
    rng = np.random.default_rng(seed)
    close = 1.1 * np.exp(np.cumsum(rng.normal(0, 4e-4, n)))
    open_ = np.concatenate([[close[0]], close[:-1]])
    wide = np.abs(rng.normal(0, 3e-4, (2, n)))
    return pd.DataFrame({"symbol": "EURUSD", "ts": pd.date_range("2024-01-01", periods=n, freq="15min"), "open": open_, "high": np.maximum(open_, close) + wide[0], "low": np.minimum(open_, close) - wide[1], "close": close, "volume": rng.uniform(100, 1000, n)})


@pytest.fixture(scope="module")
def frame():
    return bar_frame()


def sorted_pandas(df):
    return df.orderBy("ts").toPandas()


def test_rsi_and_features_against_pandas(spark, frame):
    got = sorted_pandas(features.price_features(spark.createDataFrame(frame), "15min", chunked=True))
    d = frame["close"].diff()
    up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(got["f_rsi_14"][1:], (1 - 1 / (1 + up / down.replace(0, np.nan)))[1:], atol=1e-9)
    r = np.log(frame["close"]).diff()
    np.testing.assert_allclose(got["f_mom_12"], r.rolling(12).sum(), atol=1e-9)
    np.testing.assert_allclose(got["f_vol_24"], r.rolling(24).std() * math.sqrt(24800), atol=1e-9)
    assert len(features.feature_columns(spark.createDataFrame(got.head(1)))) == 16


def test_no_lookahead_and_prefix(spark, frame):
    cut, k = frame["ts"][400], 400
    spoiled = frame.copy()
    spoiled.loc[k:, ["open", "high", "low", "close"]] *= 7.0
    f = lambda p: sorted_pandas(features.price_features(spark.createDataFrame(p), "15min", chunked=True)).pipe(lambda x: x[x["ts"] < cut]).reset_index(drop=True)
    whole = f(frame)
    pd.testing.assert_frame_equal(whole, f(spoiled))
    pd.testing.assert_frame_equal(whole, f(frame.head(k)))


def test_chunks_give_what_whole_windows_give(spark, frame):
    df = spark.createDataFrame(frame)
    op = lambda d, a: d.withColumns({"m": a.rolling(F.sum, "close", 7), "n": a.lead("close", 3)})
    a, b = sorted_pandas(in_chunks(df, AXIS, op, 7, 3, size=50)), sorted_pandas(op(df, AXIS))
    np.testing.assert_allclose(a[["m", "n"]], b[["m", "n"]], atol=1e-9)
    assert sorted_pandas(number(df, AXIS))["pos"].tolist() == list(range(600))


def test_ewm_with_nulls(spark):
    x = pd.Series(np.random.default_rng(3).normal(size=700))
    x[[0, 1, 5, 6, 300]] = np.nan
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=700, freq="h"), "x": x.astype(object).where(x.notna(), None)})
    got = sorted_pandas(ewm.ewm_mean(spark.createDataFrame(p, "symbol string, ts timestamp, x double"), AXIS, {"y": ("x", 5), "z": ("x", 60)}))
    for c, h in (("y", 5), ("z", 60)):
        np.testing.assert_allclose(got[c], x.ewm(halflife=h, adjust=True, ignore_na=False).mean(), atol=1e-12)


def test_asof_both_ways(spark):
    rng = np.random.default_rng(1)
    t0 = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"ts": t0 + pd.to_timedelta(np.sort(rng.choice(40_000, 300, False)), "min")})
    right = pd.DataFrame({"ts": t0 + pd.to_timedelta(np.sort(rng.choice(40_000, 60, False)), "min"), "v": range(60)})
    s = [spark.createDataFrame(x) for x in (left, right)]
    back = sorted_pandas(asof.asof_backward(*s, span_days=3).select("ts", F.col("matched.v").alias("v")))
    want = pd.merge_asof(left, right, on="ts")
    np.testing.assert_array_equal(back["v"].astype(float), want["v"])
    ahead = sorted_pandas(asof.asof_forward(*s, tolerance_hours=5, span_days=3).select("ts", F.col("matched.v").alias("v")))
    want = pd.merge_asof(left, right, on="ts", direction="forward", tolerance=pd.Timedelta("5h"))
    np.testing.assert_array_equal(ahead["v"].astype(float), want["v"])
    with pytest.raises(ValueError):
        asof.align_macro(s[0], s[1], 0)


def test_daylight_saving(spark):
    df = spark.createDataFrame([("2024-07-01 08:00:00",), ("2024-01-01 08:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    lon = df.select("ts", calendar.local_bucket("ts", calendar.LONDON, 1).alias("h")).orderBy("ts").collect()
    assert [r["h"] for r in lon] == [8, 9]
    rule = calendar.OpenRule()
    days = spark.createDataFrame([("2024-07-01",), ("2024-07-06",)], "d string").select(F.col("d").cast("date").alias("day"))
    got = rule.trades(days).collect()
    assert len(got) == 1 and got[0]["entry_utc"].hour == 8
    now = spark.createDataFrame([("2024-07-05 09:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("now"))
    assert str(rule.next_trade(now).first()["entry_utc"]) == "2024-07-08 08:00:00"


def test_quality_finds_defects(spark, frame):
    bad = frame.copy()
    bad.loc[10, "high"] = bad.loc[10, "low"] - 1
    bad.loc[20, "close"] = None
    bad = pd.concat([bad, bad.iloc[[30]]]).sort_values("ts")
    r = quality.validate(spark.createDataFrame(bad).withColumn("close", F.when(~F.isnan("close"), F.col("close"))).withColumn("ts", F.col("ts").cast("timestamp")), "15min")[0]
    assert not r.ok and {e.split(" ", 1)[1] for e in r.errors} >= {"duplicate timestamps", "rows with null prices", "highs below open or close"}
    assert quality.validate(spark.createDataFrame(frame).where("false"), "15min")[0].errors == ["no rows"]


def test_costs_shift_and_sizing(spark):
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=4, freq="h"), "position": [0.0, 1.0, -1.0, 0.0], "gross": [0.0] * 4})
    m = costs.CostModel(spread_pips=1.0, slippage_pips=0.0, swap_annual_pct=0.0)
    got = sorted_pandas(costs.apply_costs(spark.createDataFrame(p), m))
    np.testing.assert_allclose(got["spread_cost"], [0, 0.5e-4, 1e-4, 0.5e-4], atol=1e-15)
    assert m.breakeven == pytest.approx(1e-4) and m.amortized_breakeven(4) == pytest.approx(2.5e-5)
    df = spark.createDataFrame([(0.01, 0.1), (-0.01, None), (1e-9, 0.1)], "p double, v double")
    assert [round(r[0], 6) for r in df.select(costs.size_positions("p", "v", costs.Kelly(min_edge=1e-6))).collect()] == [0.25, 0.0, 0.0]
    with pytest.raises(ValueError):
        m.amortized_breakeven(0)


def test_ridge_and_slope_against_closed_form(spark):
    rng = np.random.default_rng(2)
    n = 300
    x = rng.normal(size=(n, 2)) * [1, 3]
    y = x @ [0.5, -0.2] + rng.normal(size=n)
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "f_a": x[:, 0], "f_b": x[:, 1], "y": y})
    split = models.Splitter(100, 50, 2, "rolling")
    df = models.with_positions(spark.createDataFrame(p), AXIS)
    beta = {r["fold"]: r["beta"] for r in models.Ridge().fit(df, AXIS, split).collect()}
    slope = {r["fold"]: r["slope"] for r in models.Slope("f_a").fit(df, AXIS, split).collect()}
    assert sorted(beta) == [0, 1, 2]
    for k in beta:
        a, b = x[k * 50 : k * 50 + 100], y[k * 50 : k * 50 + 100]
        z = (a - a.mean(0)) / a.std(0)
        w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (b - b.mean())) / a.std(0)
        np.testing.assert_allclose(beta[k][1:], w, atol=1e-9)
        assert slope[k] == pytest.approx(np.cov(a[:, 0], b)[0, 1] / a[:, 0].var())
    tested = models.test_rows(df, split)
    assert tested.groupBy("fold").count().where("count <> 50").isEmpty()
    assert tested.where("pos < fold * 50 + 102 or pos >= fold * 50 + 152").isEmpty()


def test_bootstrap_against_numpy(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0.001, 0.01, 500)
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=500, freq="h"), "r": r})
    lo, hi = metrics.bootstrap_sharpe(spark.createDataFrame(p), AXIS, "r", 252, block=20, resamples=500).first()[1:]
    idx = (rng.integers(0, 500, (500, 25))[:, :, None] + np.arange(20)).reshape(500, -1) % 500
    s = r[idx].mean(1) / r[idx].std(1, ddof=1) * math.sqrt(252)
    np.testing.assert_allclose([lo, hi], np.percentile(s, [2.5, 97.5]), atol=0.5)


def test_statistics(spark):
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert scoring.required_years(0.5) == pytest.approx(17.3, abs=1.0)
    df = spark.createDataFrame([("a", 1.0, 0.5)] * 50, "k string, p double, r double")
    flat = scoring.signed_return_test(df, ["k"], "p", "r").first()
    assert flat["t_stat"] is None and flat["p_value"] is None
    auc = scoring.roc_auc(spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, y int").withColumn("k", F.lit(1)), ["k"], "p", "y").first()["roc_auc"]
    assert auc == pytest.approx(0.75)
    p = spark.createDataFrame([(0.01,), (0.02,), (0.9,), (None,)], "p double")
    assert sum(r["rejected"] for r in scoring.benjamini_hochberg(p).collect()) == 2


def test_step_up_rule_over_many_tests(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate((np.round(rng.random(3000) ** 3, 4), np.full(200, 0.01)))
    rows = [(i, float(x)) for i, x in enumerate(p)] + [(9000, None)]
    got = {r["id"]: r["rejected"] for r in scoring.benjamini_hochberg(spark.createDataFrame(rows, "id int, p double")).collect()}
    s = np.sort(p)
    cut = max(x for k, x in enumerate(s, 1) if x <= k / len(s) * 0.1)
    assert got == {i: bool(x <= cut) for i, x in enumerate(p)} | {9000: False}


def test_trailing_rank_with_nulls(spark):
    x = pd.Series(np.random.default_rng(7).normal(size=120))
    x[[30, 40]] = np.nan
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=120, freq="h"), "x": x.astype(object).where(x.notna(), None)})
    got = sorted_pandas(spark.createDataFrame(p, "symbol string, ts timestamp, x double").withColumn("k", macro.trailing_rank(AXIS, "x", 20)))["k"]
    want = x.rolling(20, min_periods=10).apply(lambda w: (w < w[-1]).sum() / (len(w) - 1), raw=True)
    np.testing.assert_allclose(got[20:], want[20:], atol=1e-12)


def test_fills_and_ledger(spark):
    q = spark.createDataFrame([("a", "2024-01-02 09:00:00", 1.0, 1.1), ("a", "2024-01-02 09:01:00", 1.2, 1.3)], "symbol string, t string, bid double, ask double").select("symbol", F.col("t").cast("timestamp").alias("ts"), "bid", "ask")
    o = spark.createDataFrame([("a", "s", -1, 1.15), ("a", "b", 1, 0.9)], "symbol string, order_id string, side int, limit_price double").withColumns({"from_ts": F.lit("2024-01-02 08:00:00").cast("timestamp"), "until_ts": F.lit("2024-01-02 10:00:00").cast("timestamp")})
    got = {r["order_id"]: (r["filled"], r["reason"]) for r in execution.limit_fills(o, q).collect()}
    assert got == {"s": (True, "filled"), "b": (False, "limit not reached")}
    ib = execution.BROKERS["IBKR"]
    assert ib.representative_lots() == 1.0
    t = spark.createDataFrame([(-1, 0.1, 1.1, 1.099, 1.0999, 1.0991, True, 1e-4)], "direction int, lots double, mid_entry double, mid_exit double, fill_entry double, fill_exit double, filled boolean, pip double")
    r = execution.decompose_trades(t, ib).first()
    assert r["gross_pips"] == pytest.approx(r["mid_edge_pips"] - r["market_cost_pips"])


def test_governance(spark, tmp_path):
    reg = governance.Registry(tmp_path)
    p = governance.PreRegistration("h1", "d", "EURUSD", "1h", "m", 1, 0.4)
    df = spark.createDataFrame([("2022-12-31",), ("2023-01-01",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    with pytest.raises(governance.HoldoutViolation):
        reg.unlock(df, "h1")
    reg.save(p)
    with pytest.raises(governance.HoldoutViolation):
        reg.save(p)
    assert reg.unlock(df, "h1").count() == 1 and reg.accesses("h1") == 1
    assert reg.verdict("h1", 0.55)["verdict"] == "CONFIRMED"
    assert reg.verdict("h1", 0.55, ["x"])["verdict"].startswith("INCONCLUSIVE")
    assert reg.verdict("h1", 3.0)["verdict"] == "REFUTED"


def test_sources_round_trip(spark, frame, tmp_path):
    df = spark.createDataFrame(frame).withColumns({"timeframe": F.lit("15min"), "side": F.lit("mid"), "spread": F.lit(0.0)})
    root = str(tmp_path / "bars")
    tables.write_bars(df, root)
    tables.write_bars(df, root)
    assert tables.read_bars(spark, root, "EURUSD", "15min", "mid").count() == 600
    assert tables.read_bars(spark, root, "EURUSD", "15min", "bid").isEmpty()
    (tmp_path / "m.csv").write_text("DATE,DFF\n2024-01-01,5.3\n2024-01-02,.\n")
    assert tables.read_macro_csv(spark, str(tmp_path / "m.csv")).count() == 1
    raw = {tables.COT_NAME: "euro fx - chicago mercantile exchange ", tables.COT_DATE: "2024-01-02", tables.COT_INTEREST: "100", **{f"{c}_Positions_{s}_All": v for c in tables.COT_COHORTS.values() for s, v in (("Long", "30"), ("Short", "10"))}}
    import zipfile

    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("y.txt", pd.DataFrame([raw, raw | {tables.COT_NAME: "EURO FX/BRITISH POUND XRATE - CHICAGO MERCANTILE EXCHANGE"}]).to_csv(index=False))
    cot = tables.tidy_cot(tables.read_cot_zips(spark, str(tmp_path / "y.zip"))).collect()
    assert len(cot) == 1 and cot[0]["net_lev"] == pytest.approx(0.2)
    assert tables.missing_ranges(spark, root, ["EURUSD"], "15min", "mid", "2024-01-01", "2024-01-08").isEmpty()
    conf = {"defaults": {"pip": 0.0001, "offer_side": "bid"}, "instruments": {"A": {"enabled": True}, "B": {"enabled": False}}}
    assert [i.symbol for i in tables.instruments(conf)] == ["A"]


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.bars import stream_bars

    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=500, freq="7min"), "px": np.arange(500.0), "seq": range(500)})
    spark.createDataFrame(p).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    ticks = spark.read.parquet(str(tmp_path / "in"))
    stream = stream_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), "1h")
    stream.writeStream.format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.table("bars_out").collect()}
    assert got == {tuple(r) for r in bars.ticks_to_bars(ticks, "1h").select("symbol", "ts", "open", "high", "low", "close", "volume").collect()}


def test_battery_windows():
    from tidemark.plans.studies import BATTERY

    hours = {h.hid: (h.pred_window.zone, h.pred_window.start, h.pred_window.end, h.tgt_window.zone, h.tgt_window.start, h.tgt_window.end) for h in BATTERY}
    new_york, london, tokyo, sydney = "America/New_York", "Europe/London", "Asia/Tokyo", "Australia/Sydney"
    afternoon = (new_york, 12, 16)
    want = {c: (*afternoon, tokyo, 9, 12) for c in ("A1", "A4", "E1")} | {c: (*afternoon, sydney, 8, 12) for c in ("A2", "A3", "A5")} | {c: (*afternoon, london, 8, 12) for c in ("B1", "B2", "B3", "E2")}
    want |= {c: (*afternoon, new_york, 8, 12) for c in ("C1", "C2")} | {c: (tokyo, 9, 15, london, 8, 12) for c in ("D1", "D2", "D3")} | {c: (london, 8, 12, london, 8, 12) for c in ("F1", "F2")}
    assert hours == want


def test_running_over_spans(spark):
    from tidemark.functions.axis import running

    rng = np.random.default_rng(11)
    n = 3000
    x = pd.Series(rng.normal(0, 0.02, n))
    x[[0, 5, 700, 2999]] = np.nan
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-20", periods=n, freq="h"), "x": x.astype(object).where(x.notna(), None)})
    df = spark.createDataFrame(p, "symbol string, ts timestamp, x double")
    v = F.col("x")
    for grain in ("month", "day"):
        got = sorted_pandas(running(df, AXIS, {"s": ("sum", v), "m": ("max", v), "l": ("last", v), "p": ("prev", v)}, grain))
        np.testing.assert_allclose(got["s"][1:], x.cumsum().ffill()[1:], atol=1e-12)
        np.testing.assert_allclose(got["m"][1:], x.cummax().ffill()[1:])
        np.testing.assert_allclose(got["l"][1:], x.ffill()[1:])
        np.testing.assert_allclose(got["p"].astype(float), x.shift(1))
        e = sorted_pandas(metrics.with_equity(df, AXIS, "x", {"was": "x"}, grain))
        equity = (1 + x.fillna(0)).cumprod()
        np.testing.assert_allclose(e["equity"], equity, rtol=1e-12)
        np.testing.assert_allclose(e["drawdown"], equity / equity.cummax() - 1, atol=1e-12)
        np.testing.assert_allclose(e["was"].astype(float), x.shift(1))


def test_expanding_and_rolling_fold_sums(spark):
    n = 500
    y = np.random.default_rng(4).normal(size=n)
    df = models.with_positions(spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "y": y})), AXIS)
    for mode in ("expanding", "rolling"):
        split = models.Splitter(100, 40, 3, mode, step=25)
        got = {r["fold"]: r["s"] for r in models.fold_sums(df, AXIS, split, {"s": F.col("y")}).collect()}
        assert sorted(got) == list(range(split.count(n)))
        for k, s in got.items():
            assert s == pytest.approx(y[k * 25 if mode == "rolling" else 0 : k * 25 + 100].sum(), abs=1e-9)


def test_agreement_hours_and_families(spark):
    df = spark.createDataFrame([(0.2, 0.9), (0.2, 0.6), (0.2, None)], "p double, a double")
    assert [r[0] for r in df.select(costs.agreement_filter("p", "a", 0.75)).collect()] == [0.2, 0.0, 0.0]
    with pytest.raises(ValueError):
        costs.agreement_filter("p", "a", 0)
    m = costs.CostModel.from_profile({6: 0.3, 12: 0.4, 21: 1.5})
    assert m.expensive_hours() == [21] and m.cheap_hours() == [6, 12] and costs.CostModel().expensive_hours() == []
    assert features.families(["f_ret_1", "f_rate_diff", "f_ccy_rank_base", "f_dollar_5", "y"]) == {"price": ["f_ret_1"], "carry": ["f_rate_diff"], "strength": ["f_ccy_rank_base", "f_dollar_5"]}


def test_random_signal_repeats_itself(spark):
    n = 400
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "y": np.random.default_rng(1).normal(size=n)})
    run = lambda seed: sorted_pandas(models.walk_forward(spark.createDataFrame(p), AXIS, models.Splitter(100, 100, 1), {"random": models.RandomSignal(seed)}))
    a, b, c = run(0), run(0), run(1)
    pd.testing.assert_frame_equal(a, b)
    level = [np.abs(p["y"][: 100 + 100 * k]).mean() for k in a["fold"]]
    np.testing.assert_allclose(a["prediction"].abs(), level)
    assert 0.3 < (a["prediction"] > 0).mean() < 0.7 and not a["prediction"].equals(c["prediction"])
    signs = [np.sign(g["prediction"]).tolist() for _, g in a.groupby("fold")]
    assert signs[0] == signs[1]  # the same coin in each fold


def test_streamed_fills_equal_batch(spark, tmp_path):
    from tidemark.streaming.bars import stream_limit_fills

    rng = np.random.default_rng(2)
    t0 = pd.Timestamp("2024-01-02").to_pydatetime()
    kind = "symbol string, ts timestamp, kind string, order_id string, side int, limit_price double, bid double, ask double"
    quotes, orders = [], []
    for s in ("a", "b"):
        mid = 1 + np.cumsum(rng.normal(0, 0.01, 200))
        quotes += [(s, t0 + timedelta(minutes=i + 1), "quote", None, None, None, float(m - 0.001), float(m + 0.001)) for i, m in enumerate(mid)]
        orders += [(s, t0 + timedelta(minutes=int(k)), "order", f"{s}{k}", int(side), float(mid[0] + side * -0.02), None, None) for k, side in zip(range(0, 150, 15), rng.choice([-1, 1], 10), strict=True)]
    src = str(tmp_path / "in")
    spark.createDataFrame(orders + quotes, kind).coalesce(1).write.parquet(src)
    stream = stream_limit_fills(spark.readStream.schema(kind).parquet(src))
    stream.writeStream.format("memory").queryName("fills_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["order_id"], r["fill_ts"]) for r in spark.table("fills_out").collect()}
    both = spark.read.parquet(src)
    o = both.where("kind = 'order'").select("symbol", "order_id", "side", "limit_price", F.col("ts").alias("from_ts"), F.lit("2024-01-03").cast("timestamp").alias("until_ts"))
    want = {(r["order_id"], r["fill_ts"]) for r in execution.limit_fills(o, both.where("kind = 'quote'").select("symbol", "ts", "bid", "ask")).where("filled").collect()}
    assert got == want and want


def test_incremental_pull(spark, tmp_path):
    from datetime import date

    from tidemark.sources import vendor

    root, asked = str(tmp_path / "bars"), []

    def client(symbol, timeframe, lo, hi, side):
        days = pd.date_range(lo, hi, freq="D")
        if symbol == "EMPTY":
            return pd.DataFrame(columns=["ts", "open", "high", "low", "close", "volume", "spread", "timeframe", "side"])
        return pd.DataFrame({"ts": days, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0, "spread": 0.0, "timeframe": timeframe, "side": side})

    pull = lambda symbols, a, b: [tuple(r) for r in vendor.pull_bars(spark, client, root, symbols, "1D", a, b, "bid").collect()]
    assert sorted(pull(["A", "B", "EMPTY"], date(2021, 3, 1), date(2022, 6, 30))) == [(s, y) for s in ("A", "B", "EMPTY") for y in (2021, 2022)]
    got = tables.read_bars(spark, root, "A", "1D", "bid").agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    assert (got[0].date(), got[1].date(), got[2]) == (date(2021, 3, 1), date(2022, 6, 30), 487)
    assert pull(["A", "B"], date(2021, 3, 1), date(2022, 6, 30)) == []  # covered: nothing is fetched again
    assert pull(["A"], date(2021, 3, 1), date(2023, 6, 30)) == [("A", 2022), ("A", 2023)]
    assert tables.read_bars(spark, root, "EMPTY", "1D", "bid").isEmpty() and not asked
