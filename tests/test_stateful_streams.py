"""Streams against batches: late, out-of-order and expired rows, and prefixes."""

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.operators import execution
from tidemark.streaming import stateful

T0 = pd.Timestamp("2024-01-02").to_pydatetime()
KIND = "symbol string, ts timestamp, kind string, order_id string, side int, limit_price double, bid double, ask double, until_ts timestamp"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def orders_and_quotes():
    rng = np.random.default_rng(2)
    out = []
    for s in ("a", "b"):
        mid = 1 + np.cumsum(rng.normal(0, 0.01, 120))
        out += [(s, T0 + timedelta(minutes=i + 1), "quote", None, None, None, float(m - 0.001), float(m + 0.001), None) for i, m in enumerate(mid)]
        for k, side in zip(range(0, 90, 9), rng.choice([-1, 1], 10), strict=True):
            until = T0 + timedelta(minutes=int(k) + int(rng.choice([5, 40])))
            out.append((s, T0 + timedelta(minutes=int(k)), "order", f"{s}{k}", int(side), float(mid[0] + side * -0.02), None, None, until))
    return out


def run(spark, make, batches, schema, where):
    """Batches of rows, one file and one trigger each, and then one far ahead that settles all."""
    src = f"{where}/in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
        q = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(180), k
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def outcomes(df):
    return {(r["symbol"], r["order_id"]): (r["reason"], r["fill_ts"], r["fill_price"]) for r in df.collect()}


def test_orders_do_not_depend_on_how_rows_come(rocks, tmp_path):
    rows = orders_and_quotes()
    far = [(s, T0 + timedelta(days=3), "quote", None, None, None, 0.0, 99.0, None) for s in ("a", "b")]
    both = rocks.createDataFrame(rows, KIND)
    o = both.where("kind = 'order'").select("symbol", "order_id", "side", "limit_price", F.col("ts").alias("from_ts"), "until_ts")
    batch = execution.limit_fills(o, both.where("kind = 'quote'").select("symbol", "ts", "bid", "ask"))
    want = {(r["symbol"], r["order_id"]): ("filled" if r["filled"] else "expired", r["fill_ts"], r["fill_price"]) for r in batch.collect()}
    assert {v[0] for v in want.values()} == {"filled", "expired"}
    by_time = sorted(rows, key=lambda r: r[1])
    mixed = [by_time[i] for i in np.random.default_rng(1).permutation(len(by_time))]
    # within the watermark's two hours any order of arrival is right: in time, and all mixed up
    for name, batches in (("ordered", [by_time[:100], by_time[100:], far]), ("mixed", [mixed[:90], mixed[90:], far])):
        got = run(rocks, lambda df: stateful.stream_orders(df, "3 hours"), batches, KIND, tmp_path / name)
        assert outcomes(got) == want, name


def test_expiry_needs_no_further_row_and_late_rows_are_left_out(rocks, tmp_path):
    order = lambda n, m, until: ("a", T0 + timedelta(minutes=m), "order", n, 1, 1.0, None, None, T0 + timedelta(minutes=until))
    quote = lambda m, ask: ("a", T0 + timedelta(minutes=m), "quote", None, None, None, ask - 0.1, ask, None)
    batches = [[order("x", 0, 10), quote(1, 2.0)], [("b", T0 + timedelta(hours=5), "quote", None, None, None, 1.0, 1.0, None)], [quote(5, 0.5), order("z", 6, 10)], [("b", T0 + timedelta(hours=9), "quote", None, None, None, 1.0, 1.0, None)]]
    got = outcomes(run(rocks, lambda df: stateful.stream_orders(df, "1 minutes"), batches, KIND, tmp_path))
    # x ended unfilled when another symbol moved the watermark; the quote that would have filled it came too late, as did z
    assert got == {("a", "x"): ("expired", None, None)}


def test_means_equal_the_batch_and_prefixes_stay(rocks, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(s, T0 + timedelta(hours=i), float(c)) for s in ("a", "b") for i, c in enumerate(np.round(1 + np.cumsum(rng.normal(0, 0.01, 60)), 6))]
    schema = "symbol string, ts timestamp, close double"
    far = [(s, T0 + timedelta(days=30), 1.0) for s in ("a", "b")]
    p = pd.DataFrame(rows, columns=["symbol", "ts", "close"])
    want = {}
    for s, g in p.groupby("symbol"):
        d = g["close"].diff()
        up, down = (x.iloc[1:].ewm(alpha=1 / 14, adjust=False).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
        rsi = (up / (up + down)).where(down != 0)
        for i, (ts, c, m) in enumerate(zip(g["ts"], g["close"], g["close"].ewm(alpha=0.2, adjust=False).mean(), strict=True)):
            want[s, ts.to_pydatetime()] = (c, m, None if i == 0 or np.isnan(rsi.iloc[i - 1]) else rsi.iloc[i - 1])
    mixed = [rows[i] for i in np.random.default_rng(3).permutation(len(rows))]
    out = run(rocks, lambda df: stateful.stream_means(df, 0.2, 14, "100 hours"), [mixed[:50], mixed[50:], far], schema, tmp_path / "all")
    got = {(r["symbol"], r["ts"]): (r["close"], r["ewm"], r["rsi"]) for r in out.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:2] == pytest.approx(v[:2]) and (got[k][2] is None) == (v[2] is None) and (v[2] is None or got[k][2] == pytest.approx(v[2]))
    short = [r for r in rows if r[1] < T0 + timedelta(hours=25)]
    prefix = run(rocks, lambda df: stateful.stream_means(df, 0.2, 14, "100 hours"), [short, far], schema, tmp_path / "short")
    first = {(r["symbol"], r["ts"]): (r["close"], r["ewm"], r["rsi"]) for r in prefix.collect()}
    assert len(first) == 50 and all(got[k] == pytest.approx(v) for k, v in first.items())


def test_first_fills():
    q = np.array([[10, 1.0, 1.1], [20, 1.2, 1.3], [30, 0.8, 0.9]])
    far = int(stateful.FAR)
    orders = [(-1, 1.2, 0, far), (1, 0.95, 0, far), (-1, 1.0, 15, far), (1, 0.95, 0, 29), (-1, 9.0, 0, far), (1, 1.1, 10, 10)]
    assert stateful.WorkingOrders.first_fills(orders, q).tolist() == [20, 30, 20, far, far, 10]
    assert stateful.WorkingOrders.first_fills(orders, q[:0]).tolist() == [far] * 6 and len(stateful.WorkingOrders.first_fills([], q)) == 0
