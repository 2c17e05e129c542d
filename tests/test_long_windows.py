"""Look-ups, extremes and ranks whose cost does not depend on how long the window or how common the key is."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.functions.axis import Axis, in_chunks, rolling_extremes, smaller_trailing
from tidemark.operators import asof, macro

AXIS = Axis()
START = dt.datetime(2024, 1, 1)


def series_and_bars(seed=2):
    rng = random.Random(seed)
    hours = lambda: rng.choice([rng.randint(0, 2000), rng.randint(700, 730)])
    right = [(START + dt.timedelta(hours=hours()) if rng.random() > 0.02 else None, rng.choice([None, rng.random()])) for _ in range(300)]
    left = [(f"s{i % 50}", START + dt.timedelta(minutes=rng.randint(-3000, 140_000)) if rng.random() > 0.02 else None, i) for i in range(2000)]
    return left, right


def last_known(right, t):
    if t is None:
        return None
    found = [(a, v is not None, v or 0, v) for a, v in right if a is not None and a + dt.timedelta(days=1) <= t]
    if not found:
        return None
    best = max(found, key=lambda x: x[:3])
    return best[0] + dt.timedelta(days=1), best[3]


@pytest.mark.parametrize("how", [{}, {"most": 0}, {"most": 0, "span_days": 400, "deal": 7}])
def test_series_without_keys_against_every_row(spark, how):
    left, right = series_and_bars()
    out = asof.asof_series(spark.createDataFrame(left, "symbol string, ts timestamp, i int"), spark.createDataFrame(right, "ts timestamp, v double"), lag_days=1, **how)
    got = {r["i"]: (r["matched"]["ts"], r["matched"]["v"]) if r["matched"] is not None else None for r in out.collect()}
    assert got == {i: last_known(right, t) for _, t, i in left}


def test_short_series_does_not_shuffle_the_bars(spark):
    left, right = series_and_bars()
    b = spark.createDataFrame(left, "symbol string, ts timestamp, i int")
    plan = asof.asof_series(b, spark.createDataFrame(right, "ts timestamp, v double"))._jdf.queryExecution().executedPlan().toString()
    bars_side = plan[plan.index("BroadcastHashJoin") : plan.index("BroadcastExchange")]
    assert "Exchange" not in bars_side and "i#" in bars_side


def test_a_day_of_many_symbols_is_dealt_over_many_tasks(spark):
    b = spark.range(20_000).select(F.concat(F.lit("s"), F.col("id") % 1000).alias("symbol"), F.timestamp_seconds(1_704_100_000 + F.col("id") % 50_000).alias("ts"), "id").repartition(2)
    r = spark.range(30).select(F.timestamp_seconds(1_704_000_000 + F.col("id") * 7200).alias("ts"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = asof.asof_series(b, r, most=0, span_days=400)
        sizes = out.select("id", "matched.v", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("v").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 12 and max(r["n"] for r in sizes) < 4 * 20_000 / 16


def test_empty_series_and_empty_bars(spark):
    left, right = series_and_bars()
    b, r = spark.createDataFrame(left, "symbol string, ts timestamp, i int"), spark.createDataFrame(right, "ts timestamp, v double")
    none = asof.asof_series(b, r.where("false"), lag_days=1)
    assert none.count() == len(left) and none.where("matched is not null").count() == 0
    assert none.schema == asof.asof_series(b, r, lag_days=1).schema
    assert asof.asof_series(b.where("false"), r).count() == 0


def holed(n, seed):
    x = pd.Series(np.random.default_rng(seed).integers(0, 30, n).astype(float))
    x[np.random.default_rng(seed + 1).random(n) < 0.1] = np.nan
    return x


def frame_of(spark, x):
    p = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=len(x), freq="h"), "x": x.astype(object).where(x.notna(), None)})
    return spark.createDataFrame(p, "symbol string, ts timestamp, x double")


@pytest.mark.parametrize(("n", "least"), [(1, 1), (7, 3), (50, 50), (400, 10)])
def test_rolling_extremes_against_pandas(spark, n, least):
    x = holed(300, n)
    ends = {"lo": ("min", "x"), "hi": ("max", "x")}
    whole = rolling_extremes(frame_of(spark, x), AXIS, ends, n, least)
    chunked = in_chunks(frame_of(spark, x), AXIS, lambda d, a: rolling_extremes(d, a, ends, n, least), back=n, size=max(64, n))
    for out in (whole, chunked):
        got = out.orderBy("ts").toPandas()
        np.testing.assert_allclose(got["lo"].astype(float), x.rolling(n, min_periods=least).min().to_numpy(), equal_nan=True)
        np.testing.assert_allclose(got["hi"].astype(float), x.rolling(n, min_periods=least).max().to_numpy(), equal_nan=True)


@pytest.mark.parametrize("n", [1, 2, 20, 1000])
def test_smaller_values_of_a_window(n):
    v = holed(257, 3).to_numpy()
    want = [int((v[max(0, i - n + 1) : i + 1] < v[i]).sum()) for i in range(len(v))]
    assert smaller_trailing(v, n).tolist() == want
    assert smaller_trailing(np.array([]), n).tolist() == []


def test_trailing_rank_in_chunks_equals_the_whole(spark):
    x = holed(400, 5)
    df = frame_of(spark, x)
    a = df.withColumn("k", macro.trailing_rank(AXIS, "x", 60)).orderBy("ts").toPandas()["k"]
    b = macro.with_trailing_rank(df, AXIS, "x", 60, "k").orderBy("ts").toPandas()["k"]
    c = in_chunks(df, AXIS, lambda d, ax: macro.with_trailing_rank(d, ax, "x", 60, "k"), back=60, size=70).orderBy("ts").toPandas()["k"]
    np.testing.assert_allclose(a, b, equal_nan=True)
    np.testing.assert_allclose(a, c, equal_nan=True)
    r = [macro.vol_regime(df, AXIS, "x", 20, 2, 60, size=s).orderBy("ts").toPandas()["regime"] for s in (90, 1 << 18)]
    np.testing.assert_array_equal(r[0], r[1])


def test_ranks_of_long_windows_cost_what_short_ones_do():
    v = np.random.default_rng(1).normal(size=60_000)
    took = {}
    for n in (250, 10_000):
        smaller_trailing(v[:1000], n)
        t = time.perf_counter()
        smaller_trailing(v, n)
        took[n] = time.perf_counter() - t
    assert took[10_000] < 4 * took[250]
