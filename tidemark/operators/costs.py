"""Transaction costs, hurdles, position sizing and what positions earn."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis, col, running
from ..functions.scalar import clip
from ..session import cut


@dataclass(frozen=True)
class CostModel:
    """Spread, slippage and financing; ``profile`` maps UTC hours to spreads in pips."""

    pip: float = 1e-4
    spread_pips: float = 0.6
    slippage_pips: float = 0.2
    swap_annual_pct: float = 1.0
    bars_per_year: int = 24_800
    profile: dict[int, float] = field(default_factory=dict)
    ref_price: float = 1.0

    @classmethod
    def from_profile(cls, profile: dict[int, float], pip: float = 1e-4, **kw) -> CostModel:
        """The flat spread is the median of the profile."""
        v = sorted(profile.values())
        m = len(v) // 2
        flat = v[m] if len(v) % 2 else (v[m - 1] + v[m]) / 2
        return cls(pip=pip, spread_pips=flat, profile=dict(profile), **kw)

    def _per_unit(self, spread: float | Column) -> float | Column:
        return (spread / 2 + self.slippage_pips) * self.pip / self.ref_price

    @property
    def per_unit(self) -> float:
        return self._per_unit(self.spread_pips)

    @property
    def swap_per_bar(self) -> float:
        return self.swap_annual_pct / 100 / self.bars_per_year

    @property
    def breakeven(self) -> float:
        return 2 * self.per_unit

    def amortized_breakeven(self, holding_bars: float, safety: float = 1.0) -> float:
        if holding_bars <= 0:
            raise ValueError("holding_bars must be above 0")
        return safety * self.breakeven / holding_bars

    def per_unit_at(self, ts: str = "ts") -> Column:
        """Cost of a unit traded at a time of day; hours without profile have the flat spread."""
        if not self.profile:
            return F.lit(self.per_unit)
        table = F.create_map(*(F.lit(x) for h, s in sorted(self.profile.items()) for x in (int(h), float(s))))
        return self._per_unit(F.coalesce(F.try_element_at(table, F.hour(ts)), F.lit(self.spread_pips)))

    def expensive_hours(self, multiple: float = 1.5) -> list[int]:
        least = min(self.profile.values(), default=0.0)
        return sorted(h for h, s in self.profile.items() if s > least * multiple)

    def cheap_hours(self, multiple: float = 1.5) -> list[int]:
        least = min(self.profile.values(), default=0.0)
        return sorted(h for h, s in self.profile.items() if s <= least * multiple)


def turnover(axis: Axis, position: str = "position") -> Column:
    """Size traded to get to a position; the first is bought whole."""
    return F.abs(F.col(position) - F.coalesce(axis.lag(position), F.lit(0.0)))


def apply_costs(df: DataFrame, model: CostModel, axis: Axis = Axis(), gross: str = "gross", position: str = "position", carry_annual: str | None = None) -> DataFrame:
    """``df`` with spread_cost, swap_cost, carry and net.

    With ``carry_annual`` (percent a year, the last known one counts) the
    position before earns it and no flat swap is charged.
    """
    pos = F.coalesce(F.col(position), F.lit(0.0))
    lagged = {"__was": ("prev", pos)}
    if carry_annual is not None:
        lagged["__rate"] = ("last", F.col(carry_annual))
    df = running(df, axis, lagged).withColumn("__was", F.coalesce("__was", F.lit(0.0)))
    df = df.withColumn("spread_cost", F.abs(pos - F.col("__was")) * model.per_unit_at(axis.ts))
    if carry_annual is None:
        df = df.withColumn("swap_cost", F.abs(pos) * model.swap_per_bar).withColumn("carry", F.lit(0.0))
    else:
        df = df.withColumn("swap_cost", F.lit(0.0)).withColumn("carry", F.col("__was") * F.coalesce("__rate", F.lit(0.0)) / 100 / model.bars_per_year)
    return df.withColumn("net", F.col(gross) - F.col("spread_cost") - F.col("swap_cost") + F.col("carry")).drop("__was", "__rate")


@dataclass(frozen=True)
class Kelly:
    """Fractional sizing; ``min_edge`` None means the amortised hurdle."""

    fraction: float = 0.25
    max_position: float = 1.0
    min_edge: float | None = None
    vol_floor: float = 1e-6

    def __post_init__(self):
        if not 0 < self.fraction <= 1 or self.max_position <= 0 or self.vol_floor <= 0:
            raise ValueError("fraction must be in (0, 1], max_position and vol_floor above 0")


def kelly_fraction(mu: str | Column, sigma: str | Column) -> Column:
    """Full Kelly, null where the deviation is not above 0."""
    return F.when(col(sigma) > 0, col(mu) / (col(sigma) * col(sigma)))


def size_positions(predicted: str | Column, vol: str | Column, kelly: Kelly = Kelly(), min_edge: Column | None = None) -> Column:
    """Kelly fraction of each prediction inside the limits; 0 for small edges and unknown inputs."""
    floor = F.when(col(vol).isNotNull(), F.greatest(col(vol), F.lit(kelly.vol_floor)))
    edge = min_edge if min_edge is not None else F.lit(kelly.min_edge or 0.0)
    raw = clip(kelly_fraction(predicted, floor) * kelly.fraction, -kelly.max_position, kelly.max_position)
    return F.coalesce(F.when(F.abs(col(predicted)) >= edge, raw), F.lit(0.0))


def agreement_filter(prediction: str, agreement: str, least: float = 0.75) -> Column:
    """Predictions on which too few members agree become 0; an unknown agreement is none."""
    if not 0 < least <= 1:
        raise ValueError("the least agreement must be in (0, 1]")
    return F.when(F.coalesce(F.col(agreement), F.lit(0.0)) >= least, F.col(prediction)).otherwise(0.0)


def freeze_outside(df: DataFrame, axis: Axis, hours: list[int], position: str = "position") -> DataFrame:
    """``df`` whose position is that of the last allowed hour; 0 before the first."""
    kept = F.when(F.hour(axis.ts).isin(hours), F.col(position))
    return running(df, axis, {"__kept": ("last", kept)}).withColumn(position, F.coalesce("__kept", F.lit(0.0))).drop("__kept")


def lagged_vol(axis: Axis, ret: str = "market", n: int = 96) -> Column:
    """Deviation of the ``n`` returns before this row."""
    return axis.rolling(F.stddev_samp, ret, n, end=-1)


def drawdown_throttle(df: DataFrame, axis: Axis, position: str, realized: str, limit: float = 0.20, throttle: float = 0.5, into: str = "throttled") -> DataFrame:
    """``df`` with positions scaled down while the drawdown up to the bar before exceeds the limit."""
    from .metrics import with_equity

    df = running(with_equity(cut(df), axis, realized), axis, {"__deep": ("prev", F.col("drawdown") <= -limit)})
    deep = F.coalesce("__deep", F.lit(False))
    return df.withColumn(into, F.when(deep, F.col(position) * throttle).otherwise(F.col(position))).drop("equity", "drawdown", "__deep")


def mean_holding(df: DataFrame, axis: Axis, prediction: str) -> DataFrame:
    """(keys, holding_bars): bars with a sign over runs of one sign, at least 1."""
    s = df.where(F.col(prediction).isNotNull()).withColumn("__sign", F.signum(prediction))
    s = running(s, axis, {"__was": ("prev", F.col("__sign"))})
    s = s.withColumn("__new", F.col("__was").isNull() | (F.col("__was") != F.col("__sign")))
    live = F.col("__sign") != 0
    agg = s.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias("__n"), F.count_if(live).alias("__live"), F.count_if(live & F.col("__new")).alias("__runs"))
    held = F.when((F.col("__n") < 2) | (F.col("__runs") == 0), 1.0).otherwise(F.greatest(F.lit(1.0), F.col("__live") / F.nullif(F.col("__runs"), F.lit(0))))
    return agg.select(*axis.keys, held.alias("holding_bars"))
