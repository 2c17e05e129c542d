"""Fills, commissions and the trade ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.axis import Axis
from .asof import quotes_around
from .calendar import OpenRule

LOT = 100_000


@dataclass(frozen=True)
class Commission:
    """A broker's fee for each side: basis points of notional, at least a minimum in USD."""

    name: str
    rate_bps: float
    min_usd: float
    pip_value_usd: float = 10.0

    def per_side_usd(self, lots: Column, price: Column) -> Column:
        return F.greatest(lots * price * (self.rate_bps * 1e-4 * LOT), F.lit(self.min_usd))

    def per_side_pips(self, lots: Column, price: Column) -> Column:
        """Null for lots that are not above 0."""
        return F.when(lots > 0, self.per_side_usd(lots, price) / (lots * self.pip_value_usd))

    def round_trip_pips(self, lots: Column, price: Column) -> Column:
        return 2 * self.per_side_pips(lots, price)

    def representative_lots(self, price: float = 1.0) -> float:
        """The size at which the minimum stops binding; 0.01 without a minimum."""
        return 0.01 if self.min_usd <= 0 else round(self.min_usd / (self.rate_bps * 1e-4 * LOT * price), 4)


# Published fees of a few brokers.
BROKERS = {
    "IBKR": Commission("IBKR", 0.20, 2.00),
    "IC_Markets": Commission("IC_Markets", 0.35, 0.0),
    "Pepperstone": Commission("Pepperstone", 0.35, 0.0),
    "OANDA_spread_only": Commission("OANDA_spread_only", 0.0, 0.0),
}


def order_problem(side: str = "side", kind: str = "kind", limit: str = "limit_price") -> Column:
    """What is wrong with an order, null if nothing is."""
    return (
        F.when(~F.coalesce(F.col(side).isin(-1, 1), F.lit(False)), "side must be +1 or -1")
        .when(~F.coalesce(F.col(kind).isin("market", "limit"), F.lit(False)), "kind must be market or limit")
        .when((F.col(kind) == "limit") & F.col(limit).isNull(), "a limit order needs a price")
    )


def market_fill(side: str = "side", bid: str = "bid", ask: str = "ask") -> Column:
    """A sale gets the bid, a purchase pays the ask."""
    return F.when(F.col(side) == -1, F.col(bid)).otherwise(F.col(ask))


def limit_fills(orders: DataFrame, quotes: DataFrame, axis: Axis = Axis()) -> DataFrame:
    """``orders`` (symbol, order_id, side, limit_price, from_ts, until_ts) with their fills.

    A sale fills at the first quote whose bid reaches the limit, a purchase at
    the first whose ask does; both at the limit.  ``decision_mid`` is the mid
    of the first quote while the order worked; an order that saw none is
    unfilled and says so.
    """
    q = quotes.select(*axis.keys, F.col(axis.ts).alias("__ts"), "bid", "ask", F.to_date(axis.ts).alias("__d"))
    o = orders.withColumn("__d", F.explode(F.sequence(F.to_date("from_ts"), F.to_date("until_ts"))))
    seen = o.join(q, [*axis.keys, "__d"]).where(F.col("__ts").between(F.col("from_ts"), F.col("until_ts")))
    hit = F.when(F.col("side") == -1, F.col("bid") >= F.col("limit_price")).otherwise(F.col("ask") <= F.col("limit_price"))
    got = seen.groupBy(*axis.keys, "order_id").agg(F.min(F.when(hit, F.col("__ts"))).alias("fill_ts"), F.min_by((F.col("bid") + F.col("ask")) / 2, "__ts").alias("decision_mid"), F.count(F.lit(1)).alias("quotes_seen"))
    out = orders.join(got, [*axis.keys, "order_id"], "left").withColumn("filled", F.col("fill_ts").isNotNull())
    reason = F.when(F.col("filled"), "filled").when(F.coalesce("quotes_seen", F.lit(0)) == 0, "no quotes").otherwise("limit not reached")
    return out.withColumn("fill_price", F.when(F.col("filled"), F.col("limit_price"))).withColumn("reason", reason)


def execution_study(ticks: DataFrame, days: DataFrame, rule: OpenRule = OpenRule(), window_s: int = 60, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Each day's trade of a rule under aggressive, mid and passive fills, in pips.

    ``days`` has the keys and ``day``; days without quotes around either leg are left out.
    """
    trades = rule.trades(days)
    legs = trades.select(*keys, "day", F.explode(F.array(F.struct(F.lit("in").alias("leg"), F.col("entry_utc").alias("at")), F.struct(F.lit("out").alias("leg"), F.col("exit_utc").alias("at")))).alias("x")).select(*keys, "day", "x.leg", "x.at")
    stats = quotes_around(ticks, legs, window_s, rule.pip, keys)
    of = lambda leg, c: F.max(F.when(F.col("leg") == leg, F.col(c)))
    profit = lambda a, b: rule.direction * (of("out", b) - of("in", a)) / rule.pip
    near, far = ("bid_at", "ask_at") if rule.direction == -1 else ("ask_at", "bid_at")
    out = stats.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("__legs"), of("in", "spread_at").alias("spread_entry"), of("out", "spread_at").alias("spread_exit"), of("in", "drift_mean").alias("entry_drift_mean"), of("in", "mid_range").alias("entry_range"),
        of("in", "n_ticks").alias("n_ticks_entry"), profit(near, far).alias("pnl_aggressive"), profit("mid_at", "mid_at").alias("pnl_mid"), profit(far, near).alias("pnl_passive"),
    )
    return out.where("__legs = 2").drop("__legs")


def sample_days(days: DataFrame, n: int, seed: int = 0, day: str = "day") -> DataFrame:
    """``n`` weekdays drawn by a seeded hash, in order."""
    return days.where(F.weekday(day) < 5).orderBy(F.md5(F.concat_ws(":", F.col(day).cast("string"), F.lit(str(seed)))), day).limit(n).orderBy(day)


def decompose_trades(trades: DataFrame, commission: Commission, production_lots: float = 1.0) -> DataFrame:
    """``trades`` with mid edge, market cost, gross and net pips; null costs for unfilled ones."""
    pips = lambda a, b: F.col("direction") * (F.col(a) - F.col(b)) / F.col("pip")
    done = F.col("filled") & F.col("fill_entry").isNotNull() & F.col("fill_exit").isNotNull()
    price = (F.col("mid_entry") + F.col("mid_exit")) / 2
    df = trades.withColumns({
        "mid_edge_pips": pips("mid_exit", "mid_entry"),
        "market_cost_pips": F.when(done, pips("fill_entry", "mid_entry") + pips("mid_exit", "fill_exit")),
        "gross_pips": F.when(done, pips("fill_exit", "fill_entry")),
    })
    return df.withColumns({"net_pips": F.col("gross_pips") - commission.round_trip_pips(F.col("lots"), price), "net_pips_production": F.col("gross_pips") - commission.round_trip_pips(F.lit(production_lots), price)})


def ledger_summary(trades: DataFrame, commission: Commission, production_lots: float = 1.0, budget_pips: float = 0.36, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, fill rate, market cost against its budget, edge and net, at traded and production size."""
    df = decompose_trades(trades, commission, production_lots)
    f = lambda c: F.when(F.col("filled"), F.col(c))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("n_filled"), F.median(f("market_cost_pips")).alias("market_cost_pips_median"), F.avg(f("market_cost_pips")).alias("market_cost_pips_mean"),
        F.avg(f("mid_edge_pips")).alias("mid_edge_pips_mean"), F.avg(f("net_pips")).alias("net_pips_mean_traded"), F.avg(f("net_pips_production")).alias("net_pips_mean_production"),
    )
    return out.withColumns({"fill_rate": F.col("n_filled") / F.nullif(F.col("n"), F.lit(0)), "market_cost_within_budget": F.coalesce(F.col("market_cost_pips_median") <= budget_pips, F.lit(False)), "commission_rt_production_pips": commission.round_trip_pips(F.lit(production_lots), F.lit(1.0))})
