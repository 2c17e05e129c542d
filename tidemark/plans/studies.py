"""Feature screens and hypothesis batteries: many tests in one plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axis import Axis, in_chunks
from ..operators.asof import pair_contemporaneous, pair_lead
from ..operators.bars import forward_return, resample_bars
from ..operators.calendar import LONDON, NEW_YORK, SYDNEY, TOKYO, SessionWindow, session_frame
from ..operators.features import feature_columns, price_features
from ..operators.scoring import benjamini_hochberg, bonferroni, ols_one_sided, signed_return_test

LEAST_ROWS = 200


def long_panel(df: DataFrame, axis: Axis, family: str, timeframe: str, pair: str = "symbol") -> DataFrame:
    """(family, timeframe, feature, date, pair, value, fwd) of complete rows."""
    names = feature_columns(df)
    keep = [F.to_date(axis.ts).alias("date"), F.col(pair).alias("pair"), F.col("fwd").cast("double").alias("fwd")]
    wide = df.dropna(subset=[*names, "fwd"]).select(*keep, *(F.col(c).cast("double").alias(c) for c in names))
    long = wide.unpivot(["date", "pair", "fwd"], names, "feature", "value")
    return long.withColumns({"family": F.lit(family), "timeframe": F.lit(timeframe)})


def _with_next(df: DataFrame, axis: Axis) -> DataFrame:
    """``df`` with the next bar's return, on chunks of a series."""
    return in_chunks(df, axis, lambda d, a: d.withColumn("fwd", forward_return(a)), back=0, ahead=1)


def price_panel(bars: DataFrame, axis: Axis, timeframe: str, before: str | None = None) -> DataFrame:
    """Price features against the next bar's return, before the holdout."""
    df = bars.where(F.col(axis.ts) < F.lit(before).cast("timestamp")) if before else bars
    df = resample_bars(df, timeframe, axis)
    return long_panel(_with_next(price_features(df, timeframe, axis), axis), axis, "price", timeframe)


def strength_panel(pair_returns: DataFrame, pairs: list[str], targets: list[str], timeframe: str) -> DataFrame:
    """Strength features of each target pair against its next return."""
    from ..operators.strength import strength_features

    out = None
    for t in targets:
        own = pair_returns.where(F.col("pair") == t).select("ts", "pair", "r")
        own = in_chunks(own, Axis(("pair",)), lambda d, a: d.withColumn("fwd", a.lead("r")), back=0, ahead=1).select("ts", "fwd")
        got = long_panel(strength_features(pair_returns, pairs, t).join(own, "ts"), Axis(("pair",)), "strength", timeframe, "pair")
        out = got if out is None else out.unionByName(got)
    return out


def carry_panel(bars: DataFrame, daily: DataFrame, axis: Axis, timeframe: str, lag_days: int = 1) -> DataFrame:
    """Rate features against the next bar's return."""
    from ..operators.macro import with_rate_features

    df = with_rate_features(bars.select(*axis.keys, axis.ts, "close"), daily, axis, lag_days)
    return long_panel(_with_next(df, axis), axis, "carry", timeframe)


def screen(panel: DataFrame, extra_tests: int = 84, alpha: float = 0.05) -> DataFrame:
    """A signed-return test, blocked by date, for every feature; strongest first.

    Features with fewer than 200 rows or without spread are skipped; the
    threshold counts these tests and ``extra_tests`` made before.
    """
    keys = ["family", "timeframe", "feature"]
    live = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.stddev_samp("value").alias("sd")).where((F.col("n_rows") >= LEAST_ROWS) & (F.col("sd") > 0))
    tested = signed_return_test(panel, keys, "value", "fwd", "date").join(live.drop("sd"), keys)
    n = F.broadcast(live.agg(F.count(F.lit(1)).alias("n_tests")))
    out = tested.crossJoin(n).withColumn("threshold", F.lit(alpha) / F.greatest(F.lit(1), F.col("n_tests") + extra_tests))
    return out.withColumn("passes", F.coalesce(F.col("p_value") < F.col("threshold"), F.lit(False))).orderBy(F.desc_nulls_last(F.abs("t_stat")), *keys)


def full_screen(panels: list[DataFrame], extra_tests: int = 84, alpha: float = 0.05) -> DataFrame:
    """One screen of several families and timeframes: the threshold counts the tests of all panels together."""
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p)
    return screen(out, extra_tests, alpha)


@dataclass(frozen=True)
class Hypothesis:
    """A cell of a battery, fixed before any data is looked at."""

    hid: str
    predictor: str
    pred_window: SessionWindow
    target: str
    tgt_window: SessionWindow
    sign: int
    group: str = ""
    tradeable: bool = True
    pred_weekday: int | None = None


# Local hours of each market's session.
US_PM = SessionWindow(NEW_YORK, 12, 16, "US afternoon")
TOKYO_OPEN = SessionWindow(TOKYO, 9, 12, "Tokyo open")
SYDNEY_OPEN = SessionWindow(SYDNEY, 8, 12, "Sydney open")
LONDON_OPEN = SessionWindow(LONDON, 8, 12, "London open")
NY_OPEN = SessionWindow(NEW_YORK, 8, 12, "New York open")
ASIA_COMMODITY = SessionWindow(TOKYO, 9, 15, "Asian commodity session")

# Which market's session is held against which pair's next one, and the sign expected.
BATTERY = [
    Hypothesis("A1", "SP500", US_PM, "USDJPY", TOKYO_OPEN, 1, "A"),
    Hypothesis("A2", "SP500", US_PM, "AUDUSD", SYDNEY_OPEN, 1, "A"),
    Hypothesis("A3", "SP500", US_PM, "NZDUSD", SYDNEY_OPEN, 1, "A"),
    Hypothesis("A4", "NASDAQ", US_PM, "USDJPY", TOKYO_OPEN, 1, "A"),
    Hypothesis("A5", "NASDAQ", US_PM, "AUDUSD", SYDNEY_OPEN, 1, "A"),
    Hypothesis("B1", "SP500", US_PM, "USDCHF", LONDON_OPEN, 1, "B"),
    Hypothesis("B2", "SP500", US_PM, "EURUSD", LONDON_OPEN, 1, "B"),
    Hypothesis("B3", "SP500", US_PM, "GBPUSD", LONDON_OPEN, 1, "B"),
    Hypothesis("C1", "WTI", US_PM, "USDCAD", NY_OPEN, -1, "C"),
    Hypothesis("C2", "BRENT", US_PM, "USDCAD", NY_OPEN, -1, "C"),
    Hypothesis("D1", "COPPER", ASIA_COMMODITY, "AUDUSD", LONDON_OPEN, 1, "D"),
    Hypothesis("D2", "COPPER", ASIA_COMMODITY, "NZDUSD", LONDON_OPEN, 1, "D"),
    Hypothesis("D3", "GOLD", ASIA_COMMODITY, "AUDUSD", LONDON_OPEN, 1, "D"),
    Hypothesis("E1", "SP500", US_PM, "USDJPY", TOKYO_OPEN, 1, "E", pred_weekday=4),
    Hypothesis("E2", "SP500", US_PM, "EURUSD", LONDON_OPEN, 1, "E", pred_weekday=4),
    Hypothesis("F1", "SP500", LONDON_OPEN, "EURUSD", LONDON_OPEN, 1, "F", tradeable=False),
    Hypothesis("F2", "GOLD", LONDON_OPEN, "EURUSD", LONDON_OPEN, 1, "F", tradeable=False),
]


def battery_pairs(bars: DataFrame, cells: list[Hypothesis], axis: Axis = Axis(), max_gap_hours: float = 84) -> DataFrame:
    """(hid, session_date, pred_ret, tgt_start, tgt_ret, gap_hours) of all cells.

    Each distinct session table is built once; cells then share one as-of
    join, keyed by cell.
    """
    symbol = axis.keys[0]

    def frames(kind: str) -> DataFrame:
        out, done = None, {}
        for h in cells:
            spec = (h.pred_window, h.pred_weekday) if kind == "pred" else (h.tgt_window, None)
            done.setdefault(spec, []).append(h)
        for (window, weekday), hs in done.items():
            table = [(h.hid, h.predictor if kind == "pred" else h.target) for h in hs]
            cell = F.broadcast(bars.sparkSession.createDataFrame(table, f"hid string, {symbol} string"))
            own = bars.where(F.col(symbol).isin(sorted({t[1] for t in table})))
            got = session_frame(own, window, axis, weekday).join(cell, symbol).drop(symbol)
            out = got if out is None else out.unionByName(got)
        return out

    pred, tgt = frames("pred"), frames("tgt")
    trade = [h.hid for h in cells if h.tradeable]
    lead = pair_lead(pred.where(F.col("hid").isin(trade)), tgt.where(F.col("hid").isin(trade)), ("hid",), max_gap_hours)
    same = pair_contemporaneous(pred.where(~F.col("hid").isin(trade)), tgt.where(~F.col("hid").isin(trade)), ("hid",))
    return lead.unionByName(same)


def run_battery(spark: SparkSession, bars: DataFrame, cells: list[Hypothesis] = BATTERY, axis: Axis = Axis(), start: str | None = None, before: str | None = None, q: float = 0.10, least: int = 100, tests_before: int = 180) -> DataFrame:
    """A row for each cell: slope test in its sign, signed-return test, and which survive the false discovery rate."""
    pairs = battery_pairs(bars, cells, axis)
    pairs = pairs.where(F.col("tgt_start") >= F.lit(start).cast("timestamp")) if start else pairs
    pairs = pairs.where(F.col("tgt_start") < F.lit(before).cast("timestamp")) if before else pairs
    table = spark.createDataFrame([(h.hid, h.group, h.predictor, h.target, h.sign, h.tradeable) for h in cells], "hid string, cell_group string, predictor string, target string, sign int, tradeable boolean")
    df = pairs.join(F.broadcast(table.select("hid", "sign")), "hid").withColumn("oriented", F.col("pred_ret") * F.col("sign"))
    counts = df.groupBy("hid").agg(F.count(F.lit(1)).alias("n_pairs"), F.median("gap_hours").alias("median_gap_h"))
    slope = ols_one_sided(df, ["hid"], "pred_ret", "tgt_ret", "sign").drop("n", "sign")
    signed = signed_return_test(df, ["hid"], "oriented", "tgt_ret", F.to_date("tgt_start")).select("hid", F.col("t_stat").alias("t_signed"), "mean_signed_return")
    out = table.join(counts, "hid", "left").join(slope, "hid", "left").join(signed, "hid", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long")))
    enough = F.col("n_pairs") >= least
    kept = ["median_gap_h", "slope", "corr", "t_ols", "p_two_sided", "p_one_sided", "sign_matches", "t_signed", "mean_signed_return"]
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in kept}).withColumn("status", F.when(enough, "ok").otherwise("too_few_obs"))
    out = benjamini_hochberg(out, "p_one_sided", q, F.col("tradeable"))
    return out.withColumn("bonferroni", F.lit(bonferroni(tests_before + sum(h.tradeable for h in cells)))).orderBy(F.asc_nulls_last("p_one_sided"), "hid")
