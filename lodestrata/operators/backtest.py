"""Self-financing simulation without sequential state.

Between decisions holdings drift by running products of returns. At a decision the cost
factor phi = NAV after / NAV before solves phi + sum c |w phi - u| = 1, with u the
drifted weights: it depends on no level, so every decision is solved alone. Gross wealth
is then the product of period growths, net wealth that times the product of phis. The
first decision forms the book from cash: u = 0 and phi = 1 / (1 + c).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.stats import annual_vol, cagr
from lodestrata.operators.asof import holding_rows

STEPS = 8


@dataclass(frozen=True)
class CostModel:
    """A cost as an expression of the traded amount (bought positive), and its name."""

    name: str
    of: Callable[[Column], Column]

    def total(self, trade: Column) -> Column:
        """Aggregate: the cost of a decision's trades."""
        return F.sum(self.of(trade)).alias(self.name)


def no_cost() -> CostModel:
    return CostModel("none", lambda trade: F.lit(0.0) * trade)


def linear_cost(bps: float, name: str = "linear") -> CostModel:
    if bps < 0:
        raise ValueError("a cost rate must not be negative")
    return CostModel(name, lambda trade: F.abs(trade) * (bps / 10000.0))


def cost_model(kind: str, bps: float) -> CostModel:
    """The model of a configuration's name and rate."""
    if kind == "zero":
        return no_cost()
    if kind == "linear":
        return linear_cost(bps)
    raise ValueError(f"unknown cost model: {kind}")


def rate_fault(bps: Column) -> Column:
    """Why a rate is refused, null if it is not: it must be a number from 0 to below all."""
    finite = bps.isNotNull() & ~F.isnan(bps) & (F.abs(bps) != float("inf"))
    return F.when(~finite, "NOT_FINITE").when(bps < 0, "NEGATIVE").when(bps >= 10000, "ALL_OR_MORE")


def asset_costs(execs: DataFrame, rates: DataFrame) -> DataFrame:
    """strategy, as_of, cost: each asset's own rate on what is traded. rates: asset, bps;
    a trade without a valid rate fails the query."""
    met = execs.join(rates, "asset", "left")
    return met.groupBy("strategy", "as_of").agg(F.sum(F.abs(F.col("weight") - F.col("drifted")) * _rate()).alias("cost"))


def _rate() -> Column:
    """bps of asset as a share; a rate that is missing or refused fails the query."""
    fault = rate_fault(F.col("bps"))
    return F.when(fault.isNull(), F.col("bps") / 10000.0).otherwise(F.raise_error(F.concat(F.lit("cost rate of "), F.col("asset"), F.lit(": "), fault)).cast("double"))


def invariants(values: DataFrame, keys: list[str], cash: Column) -> DataFrame:
    """Per key: invested, cash, nav, and whether the state holds: no short holding, no
    debt, finite, and shares that add up to one. values: keys, value."""
    out = values.groupBy(*keys).agg(F.sum("value").alias("invested"), F.min("value").alias("least")).withColumn("cash", cash).withColumn("nav", F.col("invested") + F.col("cash"))
    finite = F.abs("nav") < float("inf")  # false beside a NaN or null
    whole = F.abs(F.col("invested") / F.col("nav") + F.col("cash") / F.col("nav") - 1) <= 1e-12
    return out.withColumn("holds", F.coalesce((F.col("least") >= 0) & (F.col("cash") >= 0) & (F.col("nav") > 0) & finite & whole, F.lit(False))).drop("least")


def states(weights: DataFrame, growths: DataFrame, cash: float) -> DataFrame:
    """Holdings and cash of books day by day: strategy, as_of, date, invested, cash, nav, holds."""
    values = weights.join(growths, ["as_of", "asset"]).withColumn("value", F.col("weight") * F.col("growth"))
    return invariants(values, ["strategy", "as_of", "date"], F.lit(cash))


def clock_returns(books: DataFrame, panel: DataFrame) -> DataFrame:
    """Per decision: the last date it may know, what the old book earns on its day, when the
    new book first earns, and what. books: as ``book_growth``; panel: date."""
    by_day = Window.partitionBy("strategy", "as_of").orderBy("date")
    days = books.withColumns({"ret": F.col("growth") / F.coalesce(F.lag("growth").over(by_day), F.lit(1.0)) - 1, "r": F.row_number().over(by_day)})
    new = days.where("r = 1").select("strategy", "as_of", F.col("date").alias("first_earned"), F.col("ret").alias("new_book_return"))
    old = days.where("date > as_of").select("strategy", F.col("date").alias("as_of"), F.col("ret").alias("old_book_return"))
    dates = panel.select("date").distinct()
    known = dates.select(F.lag("date").over(Window.orderBy("date")).alias("known_until"), F.col("date").alias("as_of"))  # a row a date
    return new.join(old, ["strategy", "as_of"], "left").join(known, "as_of", "left")


@dataclass(frozen=True)
class Execution:
    """When a decision may know and when it trades: information ends ``lag`` rows before
    the row at whose close it executes."""

    name: str = "close"
    lag: int = 1

    def clock(self, calendar: DataFrame, schedule: DataFrame) -> DataFrame:
        """as_of, information_as_of, executed_at. calendar: date, pos; schedule: as_of, pos."""
        known = calendar.select(F.col("date").alias("information_as_of"), (F.col("pos") + self.lag).alias("pos"))
        return schedule.select("as_of", "pos").join(known, "pos", "left").select("as_of", "information_as_of", F.col("as_of").alias("executed_at"))


def cost_factor(weights: Column, drifted: Column, rate: Column, steps: int = STEPS) -> Column:
    """weights, drifted: arrays in one asset order; contraction to machine precision."""
    gaps = lambda phi: F.aggregate(F.zip_with(weights, drifted, lambda w, u: F.abs(w * phi - u)), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1.0), lambda phi, _: 1 - rate * gaps(phi))


def asset_cost_factor(trades: Column, steps: int = STEPS) -> Column:
    """trades: an array of weight, drifted and rate. The factor at which what is left pays for
    each asset's trade at its own rate; a contraction by the largest rate."""
    paid = lambda phi: F.aggregate(trades, F.lit(0.0), lambda a, x: a + x["rate"] * F.abs(x["weight"] * phi - x["drifted"]))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1.0), lambda phi, _: 1 - paid(phi))


def asset_growth(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """as_of, asset, date, growth since the close of as_of."""
    run = Window.partitionBy("as_of", "asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return holding_rows(panel, schedule).withColumn("growth", F.product(1 + F.col("ret")).over(run)).select("as_of", "asset", "date", "growth")


def book_growth(weights: DataFrame, growths: DataFrame) -> DataFrame:
    """strategy, as_of, date, growth of the book since as_of. weights: strategy, as_of, asset, weight."""
    return weights.join(growths, ["as_of", "asset"]).groupBy("strategy", "as_of", "date").agg(F.sum(F.col("weight") * F.col("growth")).alias("growth"))


def executions(weights: DataFrame, growths: DataFrame, schedule: DataFrame) -> DataFrame:
    """Per strategy, decision and asset: target weight, drifted weight before, is_initial."""
    last = growths.groupBy("as_of", "asset").agg(F.max_by("growth", "date").alias("g"))
    ended = weights.join(last, ["as_of", "asset"]).withColumn("value", F.col("weight") * F.col("g"))
    ended = ended.withColumn("u", F.col("value") / F.sum("value").over(Window.partitionBy("strategy", "as_of")))
    nexts = schedule.where("next_as_of IS NOT NULL").select("as_of", "next_as_of")
    before = ended.join(nexts, "as_of").select("strategy", F.col("next_as_of").alias("as_of"), "asset", F.col("u").alias("drifted"))
    first = schedule.agg(F.min("as_of").alias("first"))
    both = weights.join(before, ["strategy", "as_of", "asset"], "full").fillna(0.0, ["weight", "drifted"])
    return both.join(F.broadcast(first)).select("strategy", "as_of", "asset", "weight", "drifted", (F.col("as_of") == F.col("first")).alias("is_initial"))  # first is one row


def turnovers(execs: DataFrame) -> DataFrame:
    return execs.groupBy("strategy", "as_of", "is_initial").agg(F.sum(F.abs(F.col("weight") - F.col("drifted"))).alias("gross_turnover")).withColumn("one_way_turnover", F.col("gross_turnover") / 2)


def cost_factors(execs: DataFrame, costs: DataFrame) -> DataFrame:
    """strategy, as_of, cost_bps, phi, gross_turnover. costs: cost_bps (a few scenarios)."""
    packed = execs.groupBy("strategy", "as_of").agg(F.array_sort(F.collect_list(F.struct("asset", "weight", "drifted"))).alias("x"), F.sum(F.abs(F.col("weight") - F.col("drifted"))).alias("gross_turnover"))
    rate = F.col("cost_bps") / 10000.0
    both = packed.crossJoin(F.broadcast(costs))  # decisions x cost scenarios, the result's size
    return both.select("strategy", "as_of", "cost_bps", cost_factor(F.col("x.weight"), F.col("x.drifted"), rate).alias("phi"), "gross_turnover")


def asset_cost_factors(execs: DataFrame, rates: DataFrame) -> DataFrame:
    """strategy, as_of, scenario, phi, cost of the trade as a share of the wealth before it.
    rates: scenario, asset, bps for every scenario and asset that is traded."""
    scenarios = rates.groupBy("asset").agg(F.collect_list(F.struct("scenario", "bps")).alias("own"))  # a few scenarios
    met = execs.join(scenarios, "asset", "left").select("strategy", "as_of", "asset", "weight", "drifted", F.explode_outer("own").alias("own"))
    met = met.withColumns({"scenario": F.col("own.scenario"), "bps": F.col("own.bps")}).withColumn("rate", _rate())
    packed = met.groupBy("strategy", "as_of", "scenario").agg(F.array_sort(F.collect_list(F.struct("asset", "weight", "drifted", "rate"))).alias("x"))
    return packed.select("strategy", "as_of", "scenario", asset_cost_factor(F.col("x")).alias("phi"))


def wealth(weights: DataFrame, panel: DataFrame, schedule: DataFrame, costs: DataFrame, once=lambda df: df) -> DataFrame:
    """Daily paths: strategy, cost_bps, date, gross_wealth, net_wealth, gross_return,
    net_return, transaction_cost (share of net wealth before the trade). once may write
    a frame that is read again."""
    growths = once(asset_growth(panel, schedule))
    phis = once(cost_factors(executions(weights, growths, schedule), costs))
    return paths(once(book_growth(weights, growths)), phis, "cost_bps")


def asset_rate_wealth(weights: DataFrame, panel: DataFrame, schedule: DataFrame, rates: DataFrame, once=lambda df: df) -> DataFrame:
    """As ``wealth``, by scenario in place of cost_bps: every asset trades at its own rate.
    rates: scenario, asset, bps."""
    growths = once(asset_growth(panel, schedule))
    phis = once(asset_cost_factors(executions(weights, growths, schedule), rates))
    return paths(once(book_growth(weights, growths)), phis, "scenario")


def paths(books: DataFrame, phis: DataFrame, by: str) -> DataFrame:
    """Daily paths by strategy and the column ``by`` of the cost factors."""
    ends = books.groupBy("strategy", "as_of").agg(F.max_by("growth", "date").alias("g"))
    order = Window.partitionBy("strategy", by).orderBy("as_of")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = phis.join(ends, ["strategy", "as_of"]).withColumns({"gross0": F.coalesce(F.product("g").over(prior), F.lit(1.0)), "net0": F.coalesce(F.product(F.col("g")).over(prior), F.lit(1.0)) * F.product("phi").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    held = books.join(levels.select("strategy", "as_of", by, "gross0", "net0"), ["strategy", "as_of"])
    daily = held.select("strategy", by, "date", (F.col("gross0") * F.col("growth")).alias("gross_wealth"), (F.col("net0") * F.col("growth")).alias("net_wealth"))
    # the first decision's own day: the book is formed from cash at its close
    start = levels.groupBy("strategy", by).agg(F.min("as_of").alias("date"), F.min_by("gross0", "as_of").alias("gross_wealth"), F.min_by("net0", "as_of").alias("net_wealth"))
    path = daily.unionByName(start)
    trades = levels.select("strategy", by, F.col("as_of").alias("date"), (1 - F.col("phi")).alias("transaction_cost"))
    # at a decision's close the recorded wealth is after the trade
    path = path.join(trades, ["strategy", by, "date"], "left").withColumn("transaction_cost", F.coalesce("transaction_cost", F.lit(0.0)))
    first = path.date == F.min("date").over(Window.partitionBy("strategy", by))
    path = path.withColumn("net_wealth", F.when(first, F.col("net_wealth")).otherwise(F.col("net_wealth") * (1 - F.col("transaction_cost"))))
    by_day = Window.partitionBy("strategy", by).orderBy("date")
    change = lambda c: F.col(c) / F.coalesce(F.lag(c).over(by_day), F.lit(1.0)) - 1
    return path.select("strategy", by, "date", "gross_wealth", "net_wealth", change("gross_wealth").alias("gross_return"), change("net_wealth").alias("net_return"), "transaction_cost")


def metrics(paths: DataFrame, per_year: int) -> DataFrame:
    """Per strategy and cost: final wealth, CAGR, volatility, Sharpe, drawdown, costs. The
    formation day counts; drawdown starts from the first recorded wealth."""
    run = Window.partitionBy("strategy", "cost_bps").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    drawn = paths.withColumns({"dd_net": F.col("net_wealth") / F.max("net_wealth").over(run) - 1, "dd_gross": F.col("gross_wealth") / F.max("gross_wealth").over(run) - 1})
    vol = annual_vol("net_return", per_year)
    mean = F.avg("net_return") * per_year
    return drawn.groupBy("strategy", "cost_bps").agg(
        F.count("*").alias("days"), F.max_by("gross_wealth", "date").alias("final_gross_wealth"), F.max_by("net_wealth", "date").alias("final_net_wealth"),
        cagr("gross_return", per_year).alias("gross_annualized_return"), cagr("net_return", per_year).alias("net_annualized_return"),
        annual_vol("gross_return", per_year).alias("gross_volatility"), vol.alias("net_volatility"), F.when(vol > 0, mean / vol).alias("net_sharpe"),
        F.min("dd_gross").alias("gross_max_drawdown"), F.min("dd_net").alias("net_max_drawdown"), F.sum("transaction_cost").alias("total_cost"))


def ledger(paths: DataFrame, schedule: DataFrame) -> DataFrame:
    """start_nav, pre_trade_nav, cost, end_nav, executed per strategy, cost and date."""
    by_day = Window.partitionBy("strategy", "cost_bps").orderBy("date")
    start = F.coalesce(F.lag("net_wealth").over(by_day), F.lit(1.0))
    hit = schedule.select(F.col("as_of").alias("date"), F.lit(True).alias("executed"))
    pre = F.col("net_wealth") / (1 - F.col("transaction_cost"))
    return paths.join(hit, "date", "left").select("strategy", "cost_bps", "date", start.alias("start_nav"), pre.alias("pre_trade_nav"), (pre * F.col("transaction_cost")).alias("cost"), F.col("net_wealth").alias("end_nav"), F.coalesce("executed", F.lit(False)).alias("executed"))
