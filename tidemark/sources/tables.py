"""Stored bars, ticks, macro series, positioning reports, profiles and ledgers.

Bars live under ``symbol / timeframe / side / year`` partitions.  The side is
a required part of a read, so that bid, ask and mid prices never blend.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO, TextIOWrapper
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null, utc

BARS = "symbol string, timeframe string, side string, ts timestamp, open double, high double, low double, close double, volume double, spread double, year int"
TICKS = "symbol string, ts timestamp, bid double, ask double, day date"
MACRO = "obs_date timestamp, value double"
COT = "report_date timestamp, currency string, open_interest double, net_lev double, net_asset_mgr double, net_dealer double"
TRADES = "day string, entry_ts string, exit_ts string, direction int, lots double, order_kind string, mid_entry double, mid_exit double, fill_entry double, fill_exit double, filled boolean, pip double, note string"
SIDES = ("bid", "ask", "mid")

# Contract names of the weekly report and the currency each is about.
CONTRACTS = {
    "EURO FX - CHICAGO MERCANTILE EXCHANGE": "EUR",
    "BRITISH POUND - CHICAGO MERCANTILE EXCHANGE": "GBP",
    "BRITISH POUND STERLING - CHICAGO MERCANTILE EXCHANGE": "GBP",
    "JAPANESE YEN - CHICAGO MERCANTILE EXCHANGE": "JPY",
    "SWISS FRANC - CHICAGO MERCANTILE EXCHANGE": "CHF",
    "CANADIAN DOLLAR - CHICAGO MERCANTILE EXCHANGE": "CAD",
    "AUSTRALIAN DOLLAR - CHICAGO MERCANTILE EXCHANGE": "AUD",
    "NZ DOLLAR - CHICAGO MERCANTILE EXCHANGE": "NZD",
    "NEW ZEALAND DOLLAR - CHICAGO MERCANTILE EXCHANGE": "NZD",
}
# Columns of the report.
COT_NAME, COT_DATE, COT_INTEREST = "Market_and_Exchange_Names", "Report_Date_as_YYYY-MM-DD", "Open_Interest_All"
COT_COHORTS = {"lev": "Lev_Money", "asset_mgr": "Asset_Mgr", "dealer": "Dealer"}


@dataclass(frozen=True)
class Instrument:
    symbol: str
    pip: float = 1e-4
    typical_spread_pips: float = 0.6
    timeframe: str = "15min"
    side: str = "bid"
    start: str = "2015-01-01"
    end: str = "2026-07-01"
    enabled: bool = True

    @property
    def spread_price(self) -> float:
        return self.typical_spread_pips * self.pip


def instruments(config: dict, enabled_only: bool = True) -> list[Instrument]:
    """Instruments of a parsed configuration, its defaults folded into each."""
    defaults = {("side" if k == "offer_side" else k): v for k, v in config.get("defaults", {}).items()}
    known = set(Instrument.__dataclass_fields__) - {"symbol"}
    out = []
    for symbol, own in config.get("instruments", {}).items():
        merged = {**defaults, **{("side" if k == "offer_side" else k): v for k, v in (own or {}).items()}}
        out.append(Instrument(symbol, **{k: (str(v) if k in ("start", "end") else v) for k, v in merged.items() if k in known}))
    return [i for i in out if i.enabled or not enabled_only]


def load_config(path: str) -> dict:
    """A JSON or, where a parser is installed, YAML configuration."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml  # optional

    return yaml.safe_load(text)


def write_bars(bars: DataFrame, root: str) -> None:
    """Store bars; partitions that the rows touch are replaced, others stay."""
    df = nan_to_null(bars).withColumn("ts", utc("ts")).withColumn("year", F.year("ts"))
    df.repartition("symbol", "timeframe", "side", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe", "side", "year").parquet(root)


def read_bars(spark: SparkSession, root: str, symbol: str | None, timeframe: str, side: str) -> DataFrame:
    """Bars of one side; only its partitions are listed and read."""
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}")
    df = spark.read.schema(BARS).parquet(root).where((F.col("timeframe") == timeframe) & (F.col("side") == side))
    return df.where(F.col("symbol") == symbol) if symbol else df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise FileNotFoundError(f"no rows of {what}")
    return df


def write_ticks(ticks: DataFrame, root: str) -> None:
    df = nan_to_null(ticks).withColumn("ts", utc("ts")).withColumn("day", F.to_date("ts"))
    df.repartition("symbol", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "day").parquet(root)


def read_ticks(spark: SparkSession, root: str, symbol: str | None = None, day: str | None = None) -> DataFrame:
    df = spark.read.schema(TICKS).parquet(root)
    df = df.where(F.col("symbol") == symbol) if symbol else df
    return df.where(F.col("day") == F.lit(day).cast("date")) if day else df


def read_macro_csv(spark: SparkSession, path: str) -> DataFrame:
    """(obs_date, value) of a two-column CSV; a dot or other non-number is missing and left out."""
    raw = spark.read.schema("d string, v string").option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(F.expr("try_to_timestamp(d)").alias("obs_date"), F.expr("try_cast(v as double)").alias("value")).where("obs_date is not null and value is not null and not isnan(value)")


def read_cot_zips(spark: SparkSession, path: str) -> DataFrame:
    """Rows of zipped yearly report CSVs, as text columns; each archive is a year and is read by one task."""
    cols = [COT_NAME, COT_DATE, COT_INTEREST, *(f"{c}_Positions_{s}_All" for c in COT_COHORTS.values() for s in ("Long", "Short"))]

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                    for part in pd.read_csv(TextIOWrapper(f, "utf-8", errors="replace"), dtype=str, chunksize=50_000):
                        part.columns = [c.strip().strip('"') for c in part.columns]
                        yield part.reindex(columns=cols)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, ", ".join(f"`{c}` string" for c in cols))


def tidy_cot(raw: DataFrame) -> DataFrame:
    """(report_date, currency, open_interest, net_*) of the mapped contracts, by their exact names."""
    table = [(k, v) for k, v in CONTRACTS.items()]
    names = F.broadcast(raw.sparkSession.createDataFrame(table, "__name string, currency string"))  # nine rows
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    net = {f"net_{k}": (number(f"{v}_Positions_Long_All") - number(f"{v}_Positions_Short_All")) / F.nullif(number(COT_INTEREST), F.lit(0.0)) for k, v in COT_COHORTS.items()}
    df = raw.withColumn("__name", F.upper(F.trim(F.col(f"`{COT_NAME}`")))).join(names, "__name")
    return df.select(F.expr(f"try_to_timestamp(trim(`{COT_DATE}`))").alias("report_date"), "currency", number(COT_INTEREST).alias("open_interest"), *(v.alias(k) for k, v in net.items())).where("report_date is not null")


def write_profile(profile: DataFrame, path: str) -> None:
    """A symbol's spread profile (24 rows at most) as a JSON map from hour to pips."""
    rows = {str(r["hour"]): r["spread_pips"] for r in profile.select("hour", "spread_pips").orderBy("hour").limit(24).collect()}
    Path(path).write_text(json.dumps(rows, indent=1), encoding="utf-8")


def read_profile(path: str) -> dict[int, float]:
    return {int(k): float(v) for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items()}


def append_trades(trades: DataFrame, path: str) -> None:
    """Trades to an append-only ledger of JSON lines."""
    trades.write.mode("append").json(path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRADES).json(path)


def stored(spark: SparkSession, root: str) -> bool:
    """Whether anything is stored under ``root``, on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def wanted_ranges(spark: SparkSession, symbols: list[str], start: str, end: str) -> DataFrame:
    """(symbol, year, want_start, want_end): the years of [start, end], clamped to it, for each symbol."""
    one = spark.createDataFrame([(s,) for s in symbols], "symbol string").withColumn("year", F.explode(F.sequence(F.year(F.lit(start)), F.year(F.lit(end)))))
    return one.select("symbol", "year", F.greatest(F.make_date("year", F.lit(1), F.lit(1)), F.lit(start).cast("date")).alias("want_start"), F.least(F.make_date("year", F.lit(12), F.lit(31)), F.lit(end).cast("date")).alias("want_end"))


def missing_ranges(spark: SparkSession, root: str, symbols: list[str], timeframe: str, side: str, start: str, end: str) -> DataFrame:
    """(symbol, year, want_start, want_end) of the years that are to be fetched: what is stored does not span them."""
    from ..operators.quality import coverage

    want = wanted_ranges(spark, symbols, start, end)
    return coverage(read_bars(spark, root, None, timeframe, side), want) if stored(spark, root) else want
