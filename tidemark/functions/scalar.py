"""Column expressions that several operators share.  Missing values are null, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .axis import col


def divide(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def clip(x: str | Column, low: float, high: float) -> Column:
    """x held inside [low, high]; null stays null."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def held_upto(values: str, x: str, field: str = "") -> str:
    """How many of the sorted array ``values`` (or of a field of its structs) are at most ``x``, searched by halves: an SQL expression."""
    mid = "cast((s.a + s.b) div 2 as int)"
    halve = f"if({values}[{mid}]{field} <= {x}, named_struct('a', {mid} + 1, 'b', s.b), named_struct('a', s.a, 'b', {mid}))"
    # a: values known to be at most x; b: as many at most
    return f"aggregate(sequence(0, cast(log2(size({values}) + 1) as int)), named_struct('a', 0, 'b', size({values})), (s, i) -> if(s.a < s.b, {halve}, s), s -> s.a)"


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0."""
    return F.when(condition, 1.0).otherwise(0.0)


def nan_to_null(df: DataFrame) -> DataFrame:
    """``df`` with NaN replaced by null in every floating column."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def utc(ts: str | Column) -> Column:
    """A timestamp; one without a zone is taken as UTC (the session's zone)."""
    return col(ts).cast("timestamp")


def local(ts: str | Column, zone: str) -> Column:
    """The wall clock of a UTC instant in a zone, daylight saving included."""
    return F.from_utc_timestamp(col(ts), zone)


def local_hour(ts: str | Column, zone: str) -> Column:
    """Local hour with minutes and seconds as a fraction."""
    t = local(ts, zone)
    return F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0


def right_label(ts: str | Column, seconds: int) -> Column:
    """End of the right-closed bucket of ``seconds`` that holds an instant."""
    return F.timestamp_micros((F.ceil(F.unix_micros(col(ts)) / float(seconds * 1_000_000)) * seconds * 1_000_000).cast("long"))


# Hart's rational approximation of the normal tail (double precision, |error| < 1e-14).
_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf_sql(x: str) -> str:
    """The normal distribution function as an expression in standard SQL."""
    z = f"least(abs({x}), 38.0)"
    poly = lambda cs: "(" * (len(cs) - 1) + f"{cs[0]:.16e}" + "".join(f" * {z} + {c:.16e})" for c in cs[1:])
    near = f"exp(-{z} * {z} / 2) * ({poly(_NUM)}) / ({poly(_DEN)})"
    far = f"exp(-{z} * {z} / 2) / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / 2.506628274631"
    tail = f"(case when {z} < 7.07106781186547 then {near} else {far} end)"
    return f"(case when {x} > 0 then 1 - {tail} else {tail} end)"


def normal_cdf(x: str) -> Column:
    return F.expr(normal_cdf_sql(x))


def log_loss(p: str | Column, y: str | Column) -> Column:
    """Loss of a probability against a 0/1 outcome, the probability held off 0 and 1."""
    q = clip(p, 1e-15, 1 - 1e-15)
    return -(col(y) * F.log(q) + (1 - col(y)) * F.log(1 - q))


def brier(p: str | Column, y: str | Column) -> Column:
    return (col(p) - col(y)) * (col(p) - col(y))


def probability_up(predicted: str, vol: str) -> Column:
    """Chance that a normal return of this mean and deviation is above zero, held inside [0.001, 0.999]; 0.5 where unknown."""
    z = f"({predicted} / nullif({vol}, 0D))"
    p = F.when((F.col(vol) > 0) & F.col(predicted).isNotNull(), normal_cdf(z)).otherwise(0.5)
    return clip(p, 0.001, 0.999)


LN2 = math.log(2.0)
