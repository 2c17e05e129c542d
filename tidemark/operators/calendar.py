"""Calendar and session features in local market time, and session windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.axis import Axis, col
from ..functions.scalar import flag, local, local_hour

LONDON, NEW_YORK, TOKYO, SYDNEY = "Europe/London", "America/New_York", "Asia/Tokyo", "Australia/Sydney"


def _between(x: Column, low: float, high: float) -> Column:
    return flag((x >= low) & (x < high))


def session_flags(ts: str = "ts") -> dict[str, Column]:
    lon, ny, tok = (local_hour(ts, z) for z in (LONDON, NEW_YORK, TOKYO))
    out = {"f_sess_tokyo": _between(tok, 9, 15), "f_sess_london": _between(lon, 8, 16), "f_sess_ny": _between(ny, 8, 17)}
    out["f_sess_overlap"] = out["f_sess_london"] * out["f_sess_ny"]
    return out | {"f_sess_london_open": _between(lon, 8, 10), "f_sess_ny_close": _between(ny, 15, 17)}


def month_end_flags(axis: Axis, window: int = 3, strict: bool = False) -> dict[str, Column]:
    """Nearness to month, quarter and year end in calendar days.

    The end is the last day of the month that the series holds, or, with
    ``strict``, the month's last day, which does not depend on later rows.
    """
    ts = F.col(axis.ts)
    month = Window.partitionBy(*axis.keys, F.year(ts), F.month(ts))
    end = F.last_day(ts) if strict else F.max(F.to_date(ts)).over(month)
    left = F.date_diff(end, F.to_date(ts))
    at_end = flag(left <= window)
    return {
        "f_days_to_month_end": F.least(left, F.lit(15)) / 15.0,
        "f_is_month_end": at_end,
        "f_is_month_start": flag(F.day(ts) <= window),
        "f_is_quarter_end": at_end * flag(F.month(ts).isin(3, 6, 9, 12)),
        "f_is_year_end": at_end * flag(F.month(ts) == 12),
    }


def expiry_flags(ts: str = "ts") -> dict[str, Column]:
    cut = _between(local_hour(ts, NEW_YORK), 9, 11)
    monthly = flag((F.weekday(ts) == 2) & F.day(ts).between(15, 21))
    return {"f_ny_cut": cut, "f_monthly_expiry": monthly, "f_expiry_window": monthly * cut}


def week_flags(ts: str = "ts") -> dict[str, Column]:
    out = {f"f_dow_{d}": flag(F.weekday(ts) == i) for i, d in enumerate(("mon", "tue", "wed", "thu", "fri"))}
    ny = local_hour(ts, NEW_YORK)
    return out | {"f_friday_pm": flag((F.weekday(ts) == 4) & (ny >= 12)), "f_monday_am": flag((F.weekday(ts) == 0) & (ny < 12))}


def structural_features(bars: DataFrame, axis: Axis = Axis(), strict: bool = False) -> DataFrame:
    """``bars`` with 21 session, month-end, expiry and weekday columns."""
    return bars.withColumns(session_flags(axis.ts) | month_end_flags(axis, strict=strict) | expiry_flags(axis.ts) | week_flags(axis.ts))


def local_bucket(ts: str = "ts", zone: str = LONDON, hours: int = 4) -> Column:
    return (F.floor(local_hour(ts, zone) / hours) * hours).cast("int")


@dataclass(frozen=True)
class SessionWindow:
    """Half-open local hours of a market's day."""

    zone: str
    start: float
    end: float
    label: str = ""

    def __post_init__(self):
        if not 0 <= self.start < self.end <= 24:
            raise ValueError("a session needs 0 <= start < end <= 24")

    def holds(self, ts: str = "ts", weekday: int | None = None) -> Column:
        h = local_hour(ts, self.zone)
        inside = (h >= self.start) & (h < self.end)
        return inside if weekday is None else inside & (F.weekday(local(ts, self.zone)) == weekday)


def session_frame(bars: DataFrame, window: SessionWindow, axis: Axis = Axis(), weekday: int | None = None, bar_seconds: int = 0) -> DataFrame:
    """(symbol, session_date, start_utc, end_utc, ret) of each local day's session.

    The return is ln(last close / first open); days without either are left
    out.  ``bar_seconds`` moves the end to the last bar's close, for bars that
    carry the time of their start.
    """
    ts = F.col(axis.ts)
    inside = bars.where(window.holds(axis.ts, weekday)).withColumn("session_date", F.to_date(local(axis.ts, window.zone)))
    day = inside.groupBy(*axis.keys, "session_date").agg(
        F.min(ts).alias("start_utc"), F.max(ts).alias("__end"), F.min_by("open", F.when(F.col("open").isNotNull(), ts)).alias("__open"), F.max_by("close", F.when(F.col("close").isNotNull(), ts)).alias("__close"),
    )
    end = F.timestamp_seconds(F.unix_seconds("__end") + bar_seconds) if bar_seconds else F.col("__end")
    day = day.withColumn("end_utc", end).withColumn("ret", F.log(F.col("__close") / F.col("__open"))).where("ret is not null")
    return day.select(*axis.keys, "session_date", "start_utc", "end_utc", "ret")


def instant(day: str | Column, hour: float, zone: str = LONDON) -> Column:
    """The UTC instant of a local wall-clock hour of a date."""
    wall = F.timestamp_seconds(F.unix_seconds(col(day).cast("timestamp")) + int(hour * 3600))
    return F.to_utc_timestamp(wall, zone)


@dataclass(frozen=True)
class OpenRule:
    """A calendar rule: in at one local hour, out at another, on weekdays."""

    symbol: str = "EURUSD"
    direction: int = -1
    entry_hour: int = 9
    exit_hour: int = 13
    zone: str = LONDON
    pip: float = 1e-4

    def __post_init__(self):
        if self.direction not in (-1, 1):
            raise ValueError("direction must be +1 or -1")
        if not 0 <= self.entry_hour < self.exit_hour <= 24:
            raise ValueError("need 0 <= entry < exit <= 24")

    @property
    def hold_hours(self) -> int:
        return self.exit_hour - self.entry_hour

    def trades(self, days: DataFrame, day: str = "day") -> DataFrame:
        """``days`` that are weekdays, with entry_utc and exit_utc."""
        return days.where(F.weekday(day) < 5).withColumns({"entry_utc": instant(day, self.entry_hour, self.zone), "exit_utc": instant(day, self.exit_hour, self.zone)})

    def next_trade(self, now: DataFrame, ts: str = "now") -> DataFrame:
        """``now`` with the first trade whose entry is at or after each instant."""
        today = F.to_date(local(ts, self.zone))
        days = F.sequence(today, F.date_add(today, 8))
        d = now.withColumn("day", F.explode(days)).where(F.weekday("day") < 5)
        d = d.withColumns({"entry_utc": instant("day", self.entry_hour, self.zone), "exit_utc": instant("day", self.exit_hour, self.zone)}).where(F.col("entry_utc") >= F.col(ts))
        return d.groupBy(*now.columns).agg(F.min("entry_utc").alias("entry_utc"), F.min_by("exit_utc", "entry_utc").alias("exit_utc"))
