"""A price vendor as a Spark data source: a partition for each symbol and day or year.

``source(client)`` makes a data source of a client, a callable that is passed
in, so that this library needs no network and no vendor's package::

    spark.dataSource.register(source(client))
    spark.read.format("vendor").options(symbols="EURUSD,GBPUSD", timeframe="tick", side="bid", start="2024-01-01", end="2024-01-31").load()

``spark.readStream`` reads the same slices day by day.  ``pull`` stores what is
not there yet: bars year by year, ticks day by day.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut

Fetch = Callable[[str, str, date, date, str], pd.DataFrame]


@dataclass(frozen=True)
class Retry:
    """Attempts with a pause that grows by ``pause_s`` each time."""

    attempts: int = 3
    pause_s: float = 5.0

    def __call__(self, call: Callable[[], pd.DataFrame]) -> pd.DataFrame:
        for k in range(1, self.attempts + 1):
            try:
                return call()
            except (OSError, TimeoutError):
                if k == self.attempts:
                    raise
                time.sleep(self.pause_s * k)
        raise ValueError("attempts must be above 0")


def slices(start: date, end: date, ticks: bool) -> list[tuple[date, date]]:
    """Calendar years, or for ticks weekdays, clamped to [start, end]."""
    if ticks:
        days = [start + timedelta(days=i) for i in range((end - start).days + 1)]
        return [(d, d) for d in days if d.weekday() < 5]
    return [(max(start, date(y, 1, 1)), min(end, date(y, 12, 31))) for y in range(start.year, end.year + 1)]


TICK_SIDES = "symbol string, ts timestamp, bid double, ask double"
BAR = "symbol string, timeframe string, side string, ts timestamp, open double, high double, low double, close double, volume double, spread double"


@dataclass(frozen=True)
class Slice(InputPartition):
    """What one task asks for, and tries again on its own."""

    symbol: str
    start: date
    end: date


@dataclass(frozen=True)
class Request:
    """The options of the source."""

    symbols: tuple[str, ...]
    timeframe: str
    side: str
    start: date
    end: date

    @classmethod
    def of(cls, options: dict[str, str]) -> Request:
        """``symbols`` (by commas), ``timeframe`` ("tick" or bars), ``side``, ``start``, ``end``."""
        side = options.get("side", "bid")
        if side not in ("bid", "ask", "mid"):
            raise ValueError("side must be bid, ask or mid")
        symbols = tuple(s for s in options.get("symbols", "").split(",") if s)
        if not symbols:
            raise ValueError("symbols must name at least one")
        return cls(symbols, options.get("timeframe", "1h"), side, date.fromisoformat(options["start"]), date.fromisoformat(options["end"]))

    @property
    def schema(self) -> str:
        return TICK_SIDES if self.timeframe == "tick" else BAR

    def slices(self, start: date, end: date) -> list[Slice]:
        return [Slice(s, a, b) for s in self.symbols for a, b in slices(start, end, self.timeframe == "tick")]

    def rows(self, client: Fetch, retry: Retry, part: Slice, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        got = retry(lambda: client(part.symbol, self.timeframe, part.start, part.end, self.side))
        if not len(got):
            return
        got = got.assign(symbol=part.symbol, timeframe=self.timeframe, side=self.side)
        ts = pd.to_datetime(got["ts"])
        got["ts"] = ts.dt.tz_localize("UTC") if ts.dt.tz is None else ts.dt.tz_convert("UTC")
        columns = {f.name: got[f.name] if f.name in got else [None] * len(got) for f in schema}
        yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(pd.Series(list(columns[f.name])) if f.name not in got else got[f.name], type=f.type) for f in schema], schema=schema)


def source(client: Fetch, retry: Retry = Retry(), name: str = "vendor") -> type[DataSource]:
    """A data source that asks ``client``: (symbol, timeframe, first day, last day, side) to a frame with ts and prices."""
    given = name

    class Reader(DataSourceReader):
        def __init__(self, request: Request, schema: pa.Schema):
            self.request, self.schema = request, schema

        def partitions(self):
            return self.request.slices(self.request.start, self.request.end)

        def read(self, partition):
            yield from self.request.rows(client, retry, partition, self.schema)

    class StreamReader(DataSourceStreamReader):
        """Offsets are days: a batch reads the days up to the source's end that none before has read."""

        def __init__(self, request: Request, schema: pa.Schema):
            self.request, self.schema = request, schema

        def initialOffset(self):
            return {"day": self.request.start.isoformat()}

        def latestOffset(self):
            return {"day": (self.request.end + timedelta(days=1)).isoformat()}

        def partitions(self, start, end):
            a, b = (date.fromisoformat(x["day"]) for x in (start, end))
            return self.request.slices(a, b - timedelta(days=1)) if a < b else []

        def read(self, partition):
            yield from self.request.rows(client, retry, partition, self.schema)

    class Vendor(DataSource):
        @classmethod
        def name(cls):
            return given

        def schema(self):
            return Request.of(self.options).schema

        def reader(self, schema):
            return Reader(Request.of(self.options), to_arrow_schema(schema))

        def streamReader(self, schema):
            return StreamReader(Request.of(self.options), to_arrow_schema(schema))

    return Vendor


def fetch(spark: SparkSession, client: Fetch, symbols: list[str], timeframe: str, start: date, end: date, side: str, schema: str, retry: Retry = Retry()) -> DataFrame:
    """Rows of every symbol and slice; each slice is one task's work and is tried again on its own."""
    if side not in ("bid", "ask", "mid"):
        raise ValueError("side must be bid, ask or mid")
    jobs = [(s, a, b) for s in symbols for a, b in slices(start, end, timeframe == "tick")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, lo, hi in b.itertuples(index=False):
                got = retry(lambda s=s, lo=lo, hi=hi: client(s, timeframe, lo, hi, side))
                if len(got):
                    yield got.assign(symbol=s)

    table = spark.createDataFrame(jobs, "symbol string, lo date, hi date")
    return table.repartition(max(1, len(jobs))).mapInPandas(run, schema)


def pull_bars(spark: SparkSession, client: Fetch, root: str, symbols: list[str], timeframe: str, start: date, end: date, side: str, retry: Retry = Retry(), overwrite: bool = False) -> DataFrame:
    """Fetch the years in [start, end] that what is stored under ``root`` does not span, and store them; returns (symbol, year) fetched.

    Years are clamped to the range.  Covered ones are not asked for again
    (but with ``overwrite``), and a year without rows is not written.  What is
    stored of a year stays: new rows replace those of the same instant, and a
    range apart from the stored one is asked for with the time between, so a
    year never has a hole that looks covered.  A pull that was cut off is
    repeated without harm.
    """
    if side not in ("bid", "ask", "mid"):
        raise ValueError("side must be bid, ask or mid")
    from .tables import missing_ranges, read_bars, stored, wanted_ranges, write_bars

    there = stored(spark, root)
    want = wanted_ranges(spark, symbols, str(start), str(end)) if overwrite else missing_ranges(spark, root, symbols, timeframe, side, str(start), str(end))
    if there:
        have = read_bars(spark, root, None, timeframe, side).groupBy("symbol", "year").agg(F.to_date(F.min("ts")).alias("__lo"), F.to_date(F.max("ts")).alias("__hi"))
        want = want.join(have, ["symbol", "year"], "left").withColumns({"want_start": F.least("want_start", "__hi"), "want_end": F.greatest("want_end", "__lo")})
    # a row for each symbol and year
    jobs = want.select("symbol", "year", "want_start", "want_end").orderBy("symbol", "year").collect()
    done = spark.createDataFrame([(r["symbol"], r["year"]) for r in jobs], "symbol string, year int")
    if not jobs:
        return done
    columns = [x.split()[0] for x in BAR.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, _, lo, hi in b.itertuples(index=False):
                got = retry(lambda s=s, lo=lo, hi=hi: client(s, timeframe, lo, hi, side))
                if len(got):
                    yield got.assign(symbol=s, timeframe=timeframe, side=side)[columns]

    table = spark.createDataFrame([tuple(r) for r in jobs], "symbol string, year int, want_start date, want_end date")
    rows = cut(table.repartition(len(jobs)).mapInPandas(run, BAR))  # each range is asked for once
    if there:
        fresh = rows.select("symbol", "ts").distinct()
        touched = rows.select("symbol", F.year("ts").alias("year")).distinct()
        kept = read_bars(spark, root, None, timeframe, side).join(F.broadcast(touched), ["symbol", "year"], "left_semi").join(fresh, ["symbol", "ts"], "left_anti")
        rows = cut(rows.unionByName(kept.select(*columns)))
    write_bars(rows, root)
    return done


def pull_ticks(spark: SparkSession, client: Fetch, root: str, symbols: list[str], start: date, end: date, retry: Retry = Retry(), overwrite: bool = False) -> DataFrame:
    """Fetch the weekdays in [start, end] that have no partition under ``root``, and store them; returns (symbol, day) stored.

    A day is there if its partition is, whatever it spans.  Days without rows
    (holidays) are not written, and so are asked for again.
    """
    from .tables import TICKS, stored, write_ticks

    days = spark.createDataFrame([(s, a) for s in symbols for a, _ in slices(start, end, True)], "symbol string, day date")
    if stored(spark, root) and not overwrite:
        days = days.join(spark.read.schema(TICKS).parquet(root).select("symbol", "day").distinct(), ["symbol", "day"], "left_anti")
    jobs = days.orderBy("symbol", "day").collect()  # a row for each symbol and day
    if not jobs:
        return days.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.to_pylist():
                request = Request((one["symbol"],), "tick", "bid", one["day"], one["day"])
                yield from request.rows(client, retry, Slice(one["symbol"], one["day"], one["day"]), schema)

    schema = to_arrow_schema(StructType.fromDDL(TICK_SIDES))
    rows = cut(spark.createDataFrame(jobs, "symbol string, day date").repartition(len(jobs)).mapInArrow(run, TICK_SIDES))
    if not rows.isEmpty():
        write_ticks(rows, root)
    return rows.select("symbol", F.to_date("ts").alias("day")).distinct()


def pull(spark: SparkSession, client: Fetch, root: str, symbols: list[str], timeframe: str, start: date, end: date, side: str = "bid", retry: Retry = Retry(), overwrite: bool = False) -> DataFrame:
    """``pull_ticks`` for the timeframe "tick", ``pull_bars`` for all others."""
    if timeframe == "tick":
        return pull_ticks(spark, client, root, symbols, start, end, retry, overwrite)
    return pull_bars(spark, client, root, symbols, timeframe, start, end, side, retry, overwrite)
