"""As-of joins, session pairing and quotes around instants.

An as-of join is a union and a window, not a range join: both sides are cut
into spans of time, inside a span the last right row seen so far is carried,
and what earlier spans leave behind comes from a slim table with a row for
each span.  A single long series is therefore spread over many tasks.

A series that all symbols look up (rates, weekly reports) has no key that
would spread the left rows.  While its counted rows are few it becomes a
broadcast step function: a row for each stretch of time with the steps inside,
searched by halves, so the left side is not shuffled at all.  Beyond that the
left rows are dealt over hash buckets of each span and the series is repeated
for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.axis import col
from ..functions.scalar import held_upto
from ..session import cut

DAY = 86_400
STEPS = 1 << 18  # rows of a series that is broadcast, at most
PARTS = 1 << 16  # stretches of time of a broadcast series, at most
INSIDE = 256  # steps inside a stretch, at most
DEALT = 64  # hash buckets of each span's left rows, for a longer series


def _asof(left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_t: Column, right_t: Column, carry: list[str], into: str, sign: int, span_s: int, deal: int = 1) -> DataFrame:
    """``deal``: each span's left rows are dealt over so many buckets by hash, and the right rows repeated for each."""
    names = left.columns
    micros = lambda t: F.unix_micros(t.cast("timestamp")) * sign
    r = right.select(*keys, micros(right_t).alias("__t"), *carry).where("__t is not null")
    r = r.select(*keys, "__t", F.struct(F.col("__t").alias("__at"), *carry).alias("__v"), F.lit(0).alias("__side"))
    row = F.struct(*names)
    l = left.select(*keys, micros(left_t).alias("__t"), row.alias("__row"), F.lit(1).alias("__side"))
    rows = l.unionByName(r, allowMissingColumns=True).withColumn("__span", F.floor(F.col("__t") / (span_s * 1_000_000)))
    inside = Window.partitionBy(*keys, "__span").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    if deal > 1:
        rows = rows.withColumn("__deal", F.explode(F.when(F.col("__side") == 1, F.array(F.pmod(F.xxhash64(F.col("__row")), F.lit(deal)))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long")))))
        inside = Window.partitionBy(*keys, "__span", "__deal").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.groupBy(*keys, "__span").agg(F.max("__v").alias("__v"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__span").alias("__s"), F.last("__v", ignorenulls=True).over(before).alias("__c"))
    same = F.col("__span") == F.col("__s")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    found = rows.withColumn("__m", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1")
    got = F.coalesce("__m", "__c")
    out = found.join(carried, same, "left").select("__row", F.when(F.col("__t").isNotNull(), got).alias("__got"))
    fields = [F.timestamp_micros(F.col("__got.__at") * sign).alias("ts"), *(F.col(f"__got.{c}").alias(c) for c in carry)]
    return out.select("__row.*", F.when(F.col("__got").isNotNull(), F.struct(*fields)).alias(into))


def asof_backward(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = (), left_ts: str = "ts", right_ts: str = "ts", carry: list[str] | None = None, lag_days: int = 0, into: str = "matched", span_days: int = 32) -> DataFrame:
    """``left`` with the last right row stamped, ``lag_days`` later, at or before each row.

    The match is a struct of ``ts`` (the shifted stamp) and the carried
    columns, null where there is none; a null value in the matched row stays.
    """
    stamp = F.timestamp_seconds(F.unix_seconds(col(right_ts).cast("timestamp")) + lag_days * DAY) if lag_days else col(right_ts)
    carry = [c for c in right.columns if c not in (*keys, right_ts)] if carry is None else carry
    return _asof(left, right, keys, col(left_ts), stamp, carry, into, 1, span_days * DAY)


def _steps(series: DataFrame, lo: int, width: int, parts: int) -> DataFrame:
    """(part, steps): for each of ``parts`` stretches of time the sorted steps inside it, after the last one before."""
    part = F.expr(f"cast((t - {lo}) div {width} as int)")
    inside = series.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("inside"))
    every = series.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of at most PARTS rows
    filled = every.join(inside, "part", "left").withColumn("last", F.last(F.try_element_at("inside", F.lit(-1)), True).over(before))
    return filled.select("part", F.filter(F.concat(F.array("last"), F.coalesce("inside", F.expr("filter(array(last), x -> false)"))), lambda x: x.isNotNull()).alias("steps"))


def asof_series(left: DataFrame, series: DataFrame, left_ts: str = "ts", right_ts: str = "ts", carry: list[str] | None = None, lag_days: int = 0, into: str = "matched", most: int = STEPS, deal: int = DEALT, span_days: int = 32) -> DataFrame:
    """``asof_backward`` to one series that rows of all keys look up.

    Of rows with the same stamp the one with the largest values counts, as in
    ``asof_backward``.  ``series`` is computed once and counted; up to ``most``
    rows, if no short stretch of time holds very many of them, it is broadcast
    as a step function.
    """
    stamp = F.timestamp_seconds(F.unix_seconds(col(right_ts).cast("timestamp")) + lag_days * DAY) if lag_days else col(right_ts)
    carry = [c for c in series.columns if c != right_ts] if carry is None else carry
    series = cut(series.select(F.unix_micros(stamp.cast("timestamp")).alias("t"), F.struct(*carry).alias("v")).where("t is not null"))
    n, lo, hi = series.agg(F.count(F.lit(1)), F.min("t"), F.max("t")).first()
    if not n:
        kind = series.schema["v"].dataType
        fields = [F.lit(None).cast("timestamp").alias("ts"), *(F.lit(None).cast(kind[c].dataType).alias(c) for c in carry)]
        return left.withColumn(into, F.when(F.lit(False), F.struct(*fields)))
    parts = min(PARTS, n)
    width = (hi - lo) // parts + 1
    if n <= most and series.groupBy(F.expr(f"(t - {lo}) div {width}")).count().agg(F.max("count")).first()[0] <= INSIDE:
        steps = F.broadcast(_steps(series, lo, width, parts))
        t = F.unix_micros(col(left_ts).cast("timestamp"))
        part = F.expr(f"cast(least(greatest((__t - {lo}) div {width}, 0), {parts - 1}) as int)")
        out = left.withColumn("__t", t).withColumn("__part", part).join(steps.withColumnRenamed("part", "__own"), F.col("__part") == F.col("__own"), "left")
        got = out.withColumn("__got", F.expr(f"if(__t is null, null, get(steps, {held_upto('steps', '__t', '.t')} - 1))"))
        fields = [F.timestamp_micros("__got.t").alias("ts"), *(F.col(f"__got.v.{c}").alias(c) for c in carry)]
        return got.select(*left.columns, F.when(F.col("__got").isNotNull(), F.struct(*fields)).alias(into))
    right = series.select(F.timestamp_micros("t").alias("__at"), "v.*")
    return _asof(left, right, (), col(left_ts), F.col("__at"), carry, into, 1, span_days * DAY, deal)


def asof_forward(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = (), left_ts: str = "ts", right_ts: str = "ts", carry: list[str] | None = None, tolerance_hours: float | None = None, into: str = "matched", span_days: int = 32) -> DataFrame:
    """``left`` with the first right row at or after each row, null beyond the tolerance."""
    carry = [c for c in right.columns if c not in (*keys, right_ts)] if carry is None else carry
    out = _asof(left, right, keys, col(left_ts), col(right_ts), carry, into, -1, span_days * DAY)
    if tolerance_hours is None:
        return out
    gap = (F.unix_micros(f"{into}.ts") - F.unix_micros(col(left_ts).cast("timestamp"))) / 3.6e9
    return out.withColumn(into, F.when(gap <= tolerance_hours, F.col(into)))


def align_macro(bars: DataFrame, series: DataFrame, lag_days: int = 1, value: str = "value", ts: str = "ts", into: str = "value") -> DataFrame:
    """``bars`` with the value published by then: a day's value counts ``lag_days`` days later."""
    if lag_days < 1:
        raise ValueError("a day's value is not known on the day: lag_days must be at least 1")
    out = asof_series(bars, series, ts, "obs_date", [value], lag_days, "__macro")
    return out.withColumn(into, F.col(f"__macro.{value}")).drop("__macro")


def align_positioning(bars: DataFrame, cot: DataFrame, currency: str, release_lag_days: int = 6, ts: str = "ts", into: str = "cot") -> DataFrame:
    """``bars`` with the last released weekly report of a currency, as a struct."""
    if release_lag_days < 4:
        raise ValueError("reports come out on the Friday after: release_lag_days must be at least 4")
    own = cot.where(F.col("currency") == currency).drop("currency")
    return asof_series(bars, own, ts, "report_date", None, release_lag_days, into)


def pair_lead(pred: DataFrame, tgt: DataFrame, keys: tuple[str, ...] = (), max_gap_hours: float = 84) -> DataFrame:
    """Each predictor session with the next target session that starts at or after its end.

    Pairs further apart than the gap are left out; a target may serve several
    predictors.
    """
    t = tgt.select(*keys, F.col("start_utc").alias("tgt_start"), F.col("ret").alias("tgt_ret"))
    p = pred.select(*keys, "session_date", F.col("end_utc").alias("pred_end"), F.col("ret").alias("pred_ret"))
    got = asof_forward(p, t, keys, "pred_end", "tgt_start", ["tgt_ret"], max_gap_hours).where("matched is not null")
    gap = (F.unix_micros("matched.ts") - F.unix_micros("pred_end")) / 3.6e9
    return got.select(*keys, "session_date", "pred_end", "pred_ret", F.col("matched.ts").alias("tgt_start"), F.col("matched.tgt_ret").alias("tgt_ret"), gap.alias("gap_hours"))


def pair_contemporaneous(pred: DataFrame, tgt: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sessions of the same local date side by side; a control, not a trade."""
    t = tgt.select(*keys, "session_date", F.col("start_utc").alias("tgt_start"), F.col("ret").alias("tgt_ret"))
    p = pred.select(*keys, "session_date", F.col("end_utc").alias("pred_end"), F.col("ret").alias("pred_ret"))
    return p.join(t, [*keys, "session_date"]).select(*keys, "session_date", "pred_end", "pred_ret", "tgt_start", "tgt_ret", F.lit(0.0).alias("gap_hours"))


def quotes_around(ticks: DataFrame, instants: DataFrame, window_s: int = 60, pip: float = 1e-4, keys: tuple[str, ...] = ("symbol",), at: str = "at") -> DataFrame:
    """``instants`` with what the market looked like ``window_s`` seconds either side.

    The standing quote is the last of the day at or before the instant;
    instants without one, or without any tick inside the window, are left out.
    Ticks meet instants by buckets of the window's width.
    """
    prior = asof_backward(instants, ticks.select(*keys, "ts", "bid", "ask"), keys, at, "ts", ["bid", "ask"], into="__q", span_days=1)
    prior = prior.where(F.to_date("__q.ts") == F.to_date(at)).withColumns({"bid_at": F.col("__q.bid"), "ask_at": F.col("__q.ask"), "mid_at": (F.col("__q.bid") + F.col("__q.ask")) / 2}).drop("__q")
    s = F.unix_micros(F.col(at).cast("timestamp"))
    w = window_s * 1_000_000
    i = prior.withColumn("__b", F.explode(F.sequence(F.floor((s - w) / w), F.floor((s + w) / w))))
    t = ticks.select(*keys, F.col("ts").alias("__ts"), "bid", "ask", F.floor(F.unix_micros("ts") / w).alias("__b"))
    near = F.unix_micros("__ts").between(s - w, s + w)
    both = i.join(t, [*keys, "__b"]).where(near)
    mid, spread = (F.col("bid") + F.col("ask")) / 2, (F.col("ask") - F.col("bid")) / pip
    drift = F.when(F.col("__ts") > F.col(at), (mid - F.col("mid_at")) / pip)
    return both.groupBy(*instants.columns, "bid_at", "ask_at", "mid_at").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.median(spread).alias("spread_median"), F.percentile(spread, 0.9).alias("spread_p90"),
        F.avg(drift).alias("drift_mean"), F.percentile(drift, 0.9).alias("drift_p90_adverse"), ((F.max(mid) - F.min(mid)) / pip).alias("mid_range"),
    ).withColumn("spread_at", (F.col("ask_at") - F.col("bid_at")) / pip)
