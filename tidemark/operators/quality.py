"""Data-quality gates over bars, spreads by hour, and coverage of partitions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis, running
from ..functions.ranks import quantiles
from ..functions.scalar import utc
from ..session import cut
from .bars import SECONDS, width

GAP_HOURS = 49


@dataclass
class Report:
    """Findings of a series; ok without errors."""

    key: tuple
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def _gaps(bars: DataFrame, axis: Axis, into: str) -> DataFrame:
    """``bars`` with the seconds since the row before."""
    df = running(cut(bars), axis, {"__was": ("prev", F.col(axis.ts))})
    return df.withColumn(into, F.unix_seconds(axis.ts) - F.unix_seconds("__was")).drop("__was")


def quality_metrics(bars: DataFrame, timeframe: str, axis: Axis = Axis(), sequence: str | None = None) -> DataFrame:
    """One row of counts for each series.

    The row before comes from spans of time and a slim table of their ends.

    With ``sequence``, rows whose time is before the row written just before
    them count as unsorted.
    """
    name = timeframe.removesuffix("_mid").removesuffix("_bid").removesuffix("_ask")
    seconds = width(name) if name in SECONDS else 0
    df = _gaps(bars.withColumn(axis.ts, utc(axis.ts)), axis, "__gap")
    if sequence:
        df = running(df, Axis(axis.keys, sequence), {"__was": ("prev", F.col(axis.ts))}).withColumn("__back", F.col(axis.ts) < F.col("__was")).drop("__was")
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    checks = {
        "n": F.count(F.lit(1)),
        "duplicates": F.count(axis.ts) - F.count_distinct(axis.ts),
        "null_rows": F.count_if(o.isNull() | h.isNull() | low.isNull() | c.isNull()),
        "non_positive": F.count_if(F.least(o, h, low, c) <= 0),
        "high_below": F.count_if(h < F.greatest(o, c)),
        "low_above": F.count_if(low > F.least(o, c)),
        "zero_volume": F.count_if(F.col("volume") == 0) if "volume" in bars.columns else F.lit(0).cast("long"),
        "wide_gaps": F.count_if(F.col("__gap") > GAP_HOURS * 3600),
        "narrow_gaps": F.count_if((F.col("__gap") > 0) & (F.col("__gap") < seconds)),
        "unsorted": F.count_if("__back") if sequence else F.lit(0).cast("long"),
        "largest_gap_s": F.coalesce(F.max("__gap"), F.lit(0).cast("long")),
    }
    return df.groupBy(*axis.keys).agg(*(v.alias(k) for k, v in checks.items()))


def worst_gaps(bars: DataFrame, axis: Axis = Axis(), n: int = 5) -> DataFrame:
    """The ``n`` longest gaps of all series."""
    df = _gaps(bars, axis, "gap_s").where(F.col("gap_s") > GAP_HOURS * 3600)
    return df.select(*axis.keys, axis.ts, "gap_s").orderBy(F.desc("gap_s"), *axis.keys, axis.ts).limit(n)


ERRORS = {"duplicates": "duplicate timestamps", "null_rows": "rows with null prices", "non_positive": "rows with prices at or below 0", "high_below": "highs below open or close", "low_above": "lows above open or close", "narrow_gaps": "gaps below the bar width", "unsorted": "rows out of order"}
WARNINGS = {"zero_volume": "bars without volume", "wide_gaps": f"gaps above {GAP_HOURS} h"}


def validate(bars: DataFrame, timeframe: str, axis: Axis = Axis(), sequence: str | None = None) -> list[Report]:
    """Reports, one for each series; a table without rows gets one with an error."""
    missing = {"open", "high", "low", "close"} - set(bars.columns)
    if missing:
        return [Report((), [f"missing columns: {sorted(missing)}"])]
    kind = dict(bars.dtypes)[axis.ts]
    if not kind.startswith("timestamp"):
        return [Report((), [f"{axis.ts} is no timestamp but {kind}"])]
    out = []
    for r in quality_metrics(bars, timeframe, axis, sequence).collect():
        errors = [f"{r[k]} {v}" for k, v in ERRORS.items() if r[k]]
        errors += [f"{axis.ts} has no time zone"] if kind == "timestamp_ntz" else []
        out.append(Report(tuple(r[k] for k in axis.keys), errors, [f"{r[k]} {v}" for k, v in WARNINGS.items() if r[k]]))
    return out or [Report((), ["no rows"])]


def spread_by_hour(quotes: DataFrame, pip: float = 1e-4, before: str | None = None, ts: str = "ts", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Median spread in pips of each UTC hour; rows at or after ``before`` are refused.

    Medians are exact; quotes are dealt by ranges of spread, whatever the number of a symbol and hour.
    """
    q = quotes.where(F.col(ts) < F.lit(before).cast("timestamp")) if before else quotes
    q = q.select(*keys, F.hour(ts).alias("hour"), ((F.col("ask") - F.col("bid")) / pip).alias("spread"))
    return quantiles(q, [*keys, "hour"], "spread", {"spread_pips": 0.5})


def cheap_hours(profile: DataFrame, multiple: float = 1.5, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``profile`` with ``cheap``: whether an hour's spread is within ``multiple`` of the least."""
    least = profile.groupBy(*keys).agg(F.min("spread_pips").alias("__least"))
    return profile.join(least, list(keys)).withColumn("cheap", F.col("spread_pips") <= F.col("__least") * multiple).drop("__least")


def coverage(bars: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("symbol", "year"), ts: str = "ts", tolerance_days: int = 4) -> DataFrame:
    """``requests`` (keys, want_start, want_end) that the stored rows do not span, to be fetched again."""
    have = bars.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    slack = tolerance_days * 86_400
    spans = have.join(requests, list(keys)).where(
        (F.unix_seconds(F.col("__lo").cast("timestamp")) <= F.unix_seconds(F.col("want_start").cast("timestamp")) + slack)
        & (F.unix_seconds(F.col("__hi").cast("timestamp")) >= F.unix_seconds(F.col("want_end").cast("timestamp")) - slack)
    )
    return requests.join(spans.select(*keys), list(keys), "left_anti")
