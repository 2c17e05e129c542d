"""The vendor as a data source, and pulls that keep what is stored."""

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.sources import tables, vendor

NO_WAIT = vendor.Retry(2, 0.0)


def client_into(log):
    """A client that writes what it is asked for to a folder, as it runs in other processes."""

    def client(symbol, timeframe, lo, hi, side):
        with open(f"{log}/{symbol}-{timeframe}-{lo}-{hi}", "a") as f:
            f.write("x")
        if timeframe == "tick":
            ts = pd.date_range(f"{lo} 08:00", f"{lo} 08:09", freq="min")
            return pd.DataFrame({"ts": ts, "bid": 1.0, "ask": 1.1})[: 0 if symbol == "HOLIDAY" else None]
        days = pd.date_range(lo, hi, freq="D")
        return pd.DataFrame({"ts": days, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": float(lo.month), "spread": 0.0})

    return client


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def test_batches_and_streams_of_the_source(spark, log, tmp_path):
    spark.dataSource.register(vendor.source(client_into(log), NO_WAIT))
    options = {"symbols": "A,B", "timeframe": "tick", "side": "bid", "start": "2024-01-05", "end": "2024-01-09"}
    df = spark.read.format("vendor").options(**options).load()
    assert df.columns == ["symbol", "ts", "bid", "ask"] and df.rdd.getNumPartitions() == 6  # Friday, Monday and Tuesday of two symbols
    assert df.count() == 60 and {r[0] for r in df.select(F.hour("ts")).distinct().collect()} == {8}
    bars = spark.read.format("vendor").options(**options | {"timeframe": "1D", "start": "2023-12-30"}).load()
    assert bars.groupBy("symbol").count().collect()[0]["count"] == 11 and bars.rdd.getNumPartitions() == 4
    out = spark.readStream.format("vendor").options(**options).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))
    for wrong in ({"side": "last"}, {"symbols": ""}):
        with pytest.raises(Exception, match="must"):
            spark.read.format("vendor").options(**options | wrong).load().count()


def test_two_pulls_of_one_year_keep_both_halves(spark, log, tmp_path):
    root, client = str(tmp_path / "bars"), client_into(log)
    pull = lambda a, b, **kw: [tuple(r) for r in vendor.pull(spark, client, root, ["A"], "1D", a, b, "bid", NO_WAIT, **kw).collect()]
    have = lambda: tables.read_bars(spark, root, "A", "1D", "bid").agg(F.min("ts"), F.max("ts"), F.count("ts"), F.count_distinct("ts")).first()
    assert pull(date(2024, 1, 1), date(2024, 6, 30)) == [("A", 2024)] and have()[2] == 182
    assert pull(date(2024, 7, 1), date(2024, 12, 31)) == [("A", 2024)]
    got = have()
    assert (got[0].date(), got[1].date(), got[2], got[3]) == (date(2024, 1, 1), date(2024, 12, 31), 366, 366)
    assert pull(date(2024, 1, 1), date(2024, 12, 31)) == []
    assert pull(date(2024, 3, 1), date(2024, 3, 31), overwrite=True) == [("A", 2024)]
    assert have()[2:] == (366, 366)
    march = tables.read_bars(spark, root, "A", "1D", "bid").where(F.month("ts") == 3)
    assert {r[0] for r in march.select("volume").collect()} == {3.0}  # the newer row counts


def test_ranges_apart_leave_no_hole(spark, log, tmp_path):
    root, client = str(tmp_path / "bars"), client_into(log)
    for a, b in ((date(2024, 1, 1), date(2024, 2, 29)), (date(2024, 11, 1), date(2024, 12, 31)), (date(2023, 6, 1), date(2023, 6, 30))):
        vendor.pull_bars(spark, client, root, ["A"], "1D", a, b, "bid", NO_WAIT)
    assert tables.read_bars(spark, root, "A", "1D", "bid").where("year = 2024").count() == 366
    assert tables.read_bars(spark, root, "A", "1D", "bid").where("year = 2023").count() == 30


def test_ticks_day_by_day(spark, log, tmp_path):
    root, client = str(tmp_path / "ticks"), client_into(log)
    pull = lambda **kw: sorted((r["symbol"], str(r["day"])) for r in vendor.pull(spark, client, root, ["A", "HOLIDAY"], "tick", date(2024, 1, 5), date(2024, 1, 9), retry=NO_WAIT, **kw).collect())
    days = [("A", d) for d in ("2024-01-05", "2024-01-08", "2024-01-09")]
    assert pull() == days
    assert {p.name for p in log.iterdir() if p.name.startswith("A-")} == {f"A-tick-{d}-{d}" for _, d in days}  # no weekend is asked for
    stored = tables.read_ticks(spark, root)
    assert stored.count() == 30 and tables.read_ticks(spark, root, "A", "2024-01-08").count() == 10
    before = {p.name: p.stat().st_size for p in log.iterdir() if p.name.startswith("A-")}
    assert pull() == []
    assert {p.name: p.stat().st_size for p in log.iterdir() if p.name.startswith("A-")} == before  # nothing is asked for again
    assert pull(overwrite=True) == days
    assert tables.read_ticks(spark, root).count() == 30


def test_a_slice_is_tried_again(spark, tmp_path):
    marker = tmp_path / "tried"

    def client(symbol, timeframe, lo, hi, side):
        if not marker.exists():
            marker.write_text("x")
            raise TimeoutError
        return pd.DataFrame({"ts": pd.date_range(lo, periods=2, freq="h"), "bid": 1.0, "ask": 1.1})

    spark.dataSource.register(vendor.source(client, NO_WAIT, "shaky"))
    assert spark.read.format("shaky").options(symbols="A", timeframe="tick", start="2024-01-05", end="2024-01-05").load().count() == 2
