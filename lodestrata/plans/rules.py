"""Queries of cost rules, targets, states, clocks, joins of reports, and function families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import stats
from lodestrata.operators import backtest, estimators, kernels, portfolio, resampling
from lodestrata.plans.base import CAP, MEAN_HALF_LIFE, ORACLE_SQL, PER_YEAR, VOL_HALF_LIFE, W, Tables, query
from lodestrata.plans.research import _BOOKS, _EQ, _EXEC, _GROW, _MEANS, _PATHS, _REP, _SAMPLE, _STEPS, _books, _costs, _execs, _iewma, _length, _means, _rep, _scenarios, draws

# Costs and targets


@query("BT03_asset_cost_rates", _BOOKS + _GROW + _EXEC + " FINAL SELECT strategy, as_of, sum(abs(weight - drifted) * CAST(substr(asset, 2) AS INTEGER) * 2 / 10000.0) AS cost FROM ex GROUP BY 1, 2", "cost", digits=10)
def _(t: Tables) -> DataFrame:
    rates = t.cls.select("asset", (F.substring("asset", 2, 9).cast("int") * 2.0).alias("bps"))
    return backtest.asset_costs(_execs(t), rates)


_RATED = ", rt AS (SELECT asset, scenario, CASE WHEN scenario = 0 THEN 5.0 ELSE CAST(substr(asset, 2) AS INTEGER) * 2.0 END / 10000.0 AS rate FROM cls, (VALUES (0), (1)) s(scenario))"
_RATE_STEPS = _RATED + ", ph0 AS (SELECT DISTINCT strategy, as_of, CAST(scenario AS DOUBLE) AS cost_bps, 1.0 AS phi FROM ex JOIN rt ON rt.asset = ex.asset)" + "".join(f", ph{i} AS (SELECT p.strategy, p.as_of, p.cost_bps, 1 - sum(rate * abs(weight * phi - drifted)) AS phi FROM ph{i - 1} p JOIN ex ON ex.strategy = p.strategy AND ex.as_of = p.as_of JOIN rt ON rt.asset = ex.asset AND rt.scenario = p.cost_bps GROUP BY p.strategy, p.as_of, p.cost_bps)" for i in range(1, 9))
_NAMED = "CASE WHEN cost_bps = 0 THEN 'even' ELSE 'by_asset' END AS scenario"


def _rates(t: Tables) -> DataFrame:
    """Two scenarios: 5 basis points for all assets, and two times the number in the name."""
    own = {"even": F.lit(5.0), "by_asset": F.substring("asset", 2, 9).cast("int") * 2.0}
    return reduce(DataFrame.unionByName, [t.cls.select(F.lit(n).alias("scenario"), "asset", c.alias("bps")) for n, c in own.items()])


@query("BT06_asset_rate_factor", _BOOKS + _GROW + _EXEC + _RATE_STEPS + f" FINAL SELECT strategy, as_of, {_NAMED}, phi FROM ph8", "phi", digits=10)
def _(t: Tables) -> DataFrame:
    """Wealth after over wealth before a decision where every asset has a rate of its own."""
    return backtest.asset_cost_factors(_execs(t), _rates(t))


@query("BT11_asset_rate_simulation", _BOOKS + _PATHS.replace(_STEPS, _RATE_STEPS) + f" FINAL SELECT strategy, {_NAMED}, date, gross_wealth, net_wealth, gross_return, net_return, transaction_cost FROM path", "gross_wealth net_wealth gross_return net_return transaction_cost")
def _(t: Tables) -> DataFrame:
    """Net paths with a rate for every asset."""
    return backtest.asset_rate_wealth(_books(t), t.panel, t.sched, _rates(t), t.once)


@query("BT03_refused_rates", ", r AS (SELECT asset, CASE WHEN asset = 'L1' THEN -1.0 WHEN asset = 'L2' THEN 'NaN'::DOUBLE WHEN asset = 'L3' THEN 10000.0 WHEN asset = 'L4' THEN NULL ELSE 5.0 END AS bps FROM cls) FINAL SELECT asset, CASE WHEN bps IS NULL OR isnan(bps) OR isinf(bps) THEN 'NOT_FINITE' WHEN bps < 0 THEN 'NEGATIVE' WHEN bps >= 10000 THEN 'ALL_OR_MORE' END AS fault FROM r")
def _(t: Tables) -> DataFrame:
    bps = F.when(F.col("asset") == "L1", -1.0).when(F.col("asset") == "L2", float("nan")).when(F.col("asset") == "L3", 10000.0).when(F.col("asset") == "L4", F.lit(None)).otherwise(5.0)
    return t.cls.select("asset", backtest.rate_fault(bps).alias("fault"))


@query("BT04_cost_factory", _BOOKS + _GROW + _EXEC + " FINAL SELECT 'zero' AS model, strategy, as_of, 0.0 AS cost FROM ex GROUP BY 2, 3 UNION ALL SELECT 'linear', strategy, as_of, sum(abs(weight - drifted)) * 0.0015 FROM ex GROUP BY 2, 3", "cost")
def _(t: Tables) -> DataFrame:
    trade = F.col("weight") - F.col("drifted")
    cost = lambda kind, bps: _execs(t).groupBy("strategy", "as_of").agg(backtest.cost_model(kind, bps).total(trade)).toDF("strategy", "as_of", "cost").withColumn("model", F.lit(kind))
    return cost("zero", 0.0).unionByName(cost("linear", 15.0))


_TARGETS = _EQ + """, tg AS (
  SELECT 'with_cash' AS strategy, as_of, asset, weight * 0.98 AS weight FROM eq UNION ALL SELECT 'tiny_short', as_of, asset, CASE WHEN asset = 'L1' THEN -1e-9 ELSE weight END FROM eq
  UNION ALL SELECT 'short', as_of, asset, CASE WHEN asset = 'L1' THEN -0.01 ELSE weight END FROM eq UNION ALL SELECT 'levered', as_of, asset, weight * 1.2 FROM eq
  UNION ALL SELECT 'capped', as_of, asset, CASE WHEN asset = 'L1' THEN 0.3 ELSE weight * 0.5 END FROM eq UNION ALL SELECT 'not_finite', as_of, asset, CASE WHEN asset = 'L2' THEN 'NaN'::DOUBLE ELSE weight END FROM eq)"""


def _targets(t: Tables) -> DataFrame:
    eq = portfolio.equal_weight(t.win.select("as_of", "asset").distinct())
    w, first = F.col("weight"), F.col("asset") == "L1"
    kinds = {"with_cash": w * 0.98, "tiny_short": F.when(first, -1e-9).otherwise(w), "short": F.when(first, -0.01).otherwise(w), "levered": w * 1.2, "capped": F.when(first, 0.3).otherwise(w * 0.5), "not_finite": F.when(F.col("asset") == "L2", float("nan")).otherwise(w)}
    return reduce(DataFrame.unionByName, [eq.select(F.lit(k).alias("strategy"), "as_of", "asset", c.alias("weight")) for k, c in kinds.items()])


@query("BT05_target_validation", _TARGETS + """ FINAL SELECT strategy, as_of, CASE WHEN fault IS NULL THEN greatest(1 - total, 0.0) END AS cash, fault FROM (
  SELECT strategy, as_of, sum(CASE WHEN weight BETWEEN -1e-8 AND 0 THEN 0 ELSE weight END) AS total,
    CASE WHEN bool_or(weight IS NULL OR isnan(weight) OR isinf(weight)) THEN 'NOT_FINITE' WHEN min(weight) < -1e-8 THEN 'NEGATIVE' WHEN max(weight) > 0.2 + 1e-8 THEN 'ABOVE_CAP' WHEN sum(CASE WHEN weight BETWEEN -1e-8 AND 0 THEN 0 ELSE weight END) > 1 + 1e-8 THEN 'ABOVE_ONE' END AS fault
  FROM tg GROUP BY 1, 2)""", "cash")
def _(t: Tables) -> DataFrame:
    return portfolio.validated_targets(_targets(t), ["strategy", "as_of"], 0.2)


@query("BT08_state_invariants", _BOOKS + _GROW + """, v AS (SELECT strategy, b.as_of, date, 0.98 * weight * growth AS value FROM book b JOIN gr ON gr.as_of = b.as_of AND gr.asset = b.asset)
FINAL SELECT strategy, as_of, date, sum(value) AS invested, 0.02 AS cash, sum(value) + 0.02 AS nav, min(value) >= 0 AND bool_and(isfinite(value)) AND abs(sum(value) / (sum(value) + 0.02) + 0.02 / (sum(value) + 0.02) - 1) <= 1e-12 AS holds FROM v GROUP BY 1, 2, 3""", "invested cash nav")
def _(t: Tables) -> DataFrame:
    """Books with a fiftieth in cash, day by day."""
    books = _books(t).withColumn("weight", F.col("weight") * 0.98)
    return backtest.states(books, backtest.asset_growth(t.panel, t.sched), 0.02)


@query("BT08_refused_states", _EQ + " FINAL SELECT as_of, 'cash' AS case_, sum(weight) AS invested, -0.1 AS cash, FALSE AS holds FROM eq GROUP BY 1 UNION ALL SELECT as_of, 'short', sum(CASE WHEN asset = 'L1' THEN -weight ELSE weight END), 0.0, FALSE FROM eq GROUP BY 1", "invested cash")
def _(t: Tables) -> DataFrame:
    """Negative cash and a short holding do not hold."""
    eq = portfolio.equal_weight(t.win.select("as_of", "asset").distinct())
    case = lambda name, value, cash: backtest.invariants(eq.withColumn("value", value), ["as_of"], F.lit(cash)).select("as_of", F.lit(name).alias("case_"), "invested", "cash", "holds")
    return case("cash", F.col("weight"), -0.1).unionByName(case("short", F.when(F.col("asset") == "L1", -F.col("weight")).otherwise(F.col("weight")), 0.0))


@query("BT09_clock_returns", _BOOKS + _GROW + """, dy AS (SELECT *, growth / coalesce(lag(growth) OVER w, 1.0) - 1 AS ret, row_number() OVER w AS r FROM bg WINDOW w AS (PARTITION BY strategy, as_of ORDER BY date))
FINAL SELECT n.strategy, n.as_of, (SELECT max(date) FROM cal WHERE date < n.as_of) AS known_until, o.ret AS old_book_return, n.date AS first_earned, n.ret AS new_book_return FROM dy n LEFT JOIN dy o ON o.strategy = n.strategy AND o.date = n.as_of AND o.as_of < n.as_of WHERE n.r = 1""", "old_book_return new_book_return", digits=9)
def _(t: Tables) -> DataFrame:
    growths = backtest.asset_growth(t.panel, t.sched)
    return backtest.clock_returns(backtest.book_growth(_books(t), growths), t.panel)


MULTIPLES = [1.02, 1.1, 1.2, 1.3, 1.4]


def _covariances(t: Tables) -> dict[str, DataFrame]:
    return {"sample": estimators.cov_sample(t.win, PER_YEAR, W), "ewma": estimators.cov_ewma(t.win, W, PER_YEAR, VOL_HALF_LIFE), "iewma": _iewma(t), "ledoit_wolf": estimators.cov_ledoit_wolf(t.win, W, PER_YEAR)}


def grid_books(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Books of 27 strategies (three by rule, least variance under four covariances, four
    robust models at five risk ceilings), and the strategies that lack a decision."""
    parts = [_books(t).select("strategy", "as_of", "asset", "weight")]
    parts += [kernels.minimum_variance_weights(kernels.repaired(c), CAP).select(F.lit(f"gmv_{m}").alias("strategy"), "as_of", "asset", "weight") for m, c in _covariances(t).items()]
    parts.append(kernels.robust_weights(_scenarios(t, MULTIPLES)).select(F.concat_ws("_", "model", "scenario").alias("strategy"), "as_of", "asset", "weight"))
    books = t.once(reduce(DataFrame.unionByName, parts))
    need = t.sched.agg(F.count("*").alias("need"))
    have = books.groupBy("strategy").agg(F.count_distinct(F.when(F.col("asset").isNotNull(), F.col("as_of"))).alias("have"))
    lacking = have.join(F.broadcast(need), F.col("have") < F.col("need")).select("strategy")  # need is one row
    return books.where("asset IS NOT NULL"), lacking


@query("BT14_strategy_cost_grid", digits=5)
def _(t: Tables) -> DataFrame:
    """Metrics of every complete strategy at five costs."""
    books, lacking = grid_books(t)
    whole = t.once(books.join(lacking, "strategy", "left_anti"))
    return backtest.metrics(backtest.wealth(whole, t.panel, t.sched, _costs(t), t.once), PER_YEAR)


def _grid_series(t: Tables) -> DataFrame:
    """strategy, pos, ret after 5 basis points of every complete strategy of the grid."""
    books, lacking = grid_books(t)
    whole = t.once(books.join(lacking, "strategy", "left_anti"))
    paths = backtest.wealth(whole, t.panel, t.sched, _costs(t, [5.0]), t.once)
    pos = F.row_number().over(Window.partitionBy("strategy").orderBy("date")) - 1
    return t.once(paths.select("strategy", pos.alias("pos"), F.col("net_return").alias("ret")))


@query("INF06_all_books", digits=6)
def _(t: Tables) -> DataFrame:
    """Every complete strategy: intervals of its own and of its differences to two
    comparators in joint draws, and the probability of its deflated Sharpe ratio among all
    that were tried. Books of kernels are among them, so there is no SQL."""
    series = _grid_series(t)
    rep = t.once(resampling.replicate_statistics(series, draws(t, _length(series)), PER_YEAR, 3.0))
    parts = [resampling.intervals(rep, 0.95).withColumn("comparator", F.lit(None).cast("string"))]
    parts += [resampling.paired_intervals(rep, c, 0.95).withColumn("comparator", F.lit(c)) for c in ("equal", "class_equal")]
    deflated = resampling.deflated_sharpe(series.select("strategy", "ret"), PER_YEAR).select("strategy", "trials", "probability")
    return reduce(DataFrame.unionByName, parts).join(deflated, "strategy")


# Joins of reports


@query("JN03_join_on_strategy", _REP + ", ci AS (SELECT strategy, quantile_cont(sharpe, 0.025) AS ci_lower, quantile_cont(sharpe, 0.975) AS ci_upper FROM rep WHERE strategy <> 'L7' GROUP BY 1) FINAL SELECT m.strategy, m.sharpe, m.sharpe - b.sharpe AS delta, ci_lower, ci_upper FROM (SELECT strategy, avg(ret) / stddev_samp(ret) * sqrt(52) AS sharpe FROM ser GROUP BY 1) m LEFT JOIN ci ON ci.strategy = m.strategy, (SELECT avg(ret) / stddev_samp(ret) * sqrt(52) AS sharpe FROM ser WHERE strategy = 'L1') b", "sharpe delta ci_lower ci_upper")
def _(t: Tables) -> DataFrame:
    """Metrics with deltas to L1, and intervals where there are any."""
    own = t.panel.groupBy(F.col("asset").alias("strategy")).agg((F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(52.0))).alias("sharpe"))
    base = own.where("strategy = 'L1'").select(F.col("sharpe").alias("base"))
    ci = resampling.intervals(_rep(t).where("strategy <> 'L7'"), 0.95, metrics=["sharpe"]).drop("metric")
    return own.join(ci, "strategy", "left").crossJoin(F.broadcast(base)).select("strategy", "sharpe", (F.col("sharpe") - F.col("base")).alias("delta"), "ci_lower", "ci_upper")  # base is one row


@query("JN04_join_on_model", _MEANS + " FINAL SELECT a.method AS model, a.mu, b.spread FROM (SELECT method, avg(mu) AS mu FROM mean GROUP BY 1) a LEFT JOIN (SELECT method, stddev_samp(mu) AS spread FROM mean WHERE method IN ('sample', 'ewma') GROUP BY 1) b ON a.method = b.method", "mu spread")
def _(t: Tables) -> DataFrame:
    means = _means(t)
    spread = means.where("method IN ('sample', 'ewma')").groupBy("method").agg(F.stddev_samp("mu").alias("spread"))
    return means.groupBy("method").agg(F.avg("mu").alias("mu")).join(spread, "method", "left").withColumnRenamed("method", "model")


_MODELS = _SAMPLE + """, mc AS (SELECT 'nominal' AS model, * FROM cov UNION ALL SELECT 'diagonal', as_of, asset_i, asset_j, cov * CASE WHEN asset_i = asset_j THEN 1.3 ELSE 1 END FROM cov),
bd AS (SELECT as_of, model, sqrt(min(cov)) AS low, sqrt(max(cov)) AS high FROM mc WHERE asset_i = asset_j GROUP BY 1, 2),
rk AS (SELECT as_of, model, sqrt(greatest(sum(cov) / 49, 0)) AS risk FROM mc GROUP BY 1, 2)"""


def _models(t: Tables) -> DataFrame:
    cov = t.once(estimators.cov_sample(t.win, PER_YEAR, W))
    return cov.withColumn("model", F.lit("nominal")).unionByName(portfolio.diagonal_robust(cov, 0.3).withColumn("model", F.lit("diagonal")))


def _model_risks(t: Tables, models: DataFrame) -> DataFrame:
    eq = portfolio.equal_weight(t.win.select("as_of", "asset").distinct())
    return models.join(eq.select("as_of", F.col("asset").alias("asset_i"), F.col("weight").alias("wi")), ["as_of", "asset_i"]).join(eq.select("as_of", F.col("asset").alias("asset_j"), F.col("weight").alias("wj")), ["as_of", "asset_j"]).groupBy("as_of", "model").agg(F.sqrt(F.greatest(F.sum(F.col("wi") * F.col("wj") * F.col("cov")), F.lit(0.0))).alias("risk"))


@query("JN06_lookup_by_date_and_model", _MODELS + " FINAL SELECT rk.as_of, rk.model, risk, low, high, high - risk AS slack FROM rk JOIN bd ON bd.as_of = rk.as_of AND bd.model = rk.model", "risk low high slack")
def _(t: Tables) -> DataFrame:
    """Bounds of each date and model onto that model's risk of equal weights."""
    models = _models(t)
    bounds = models.where("asset_i = asset_j").groupBy("as_of", "model").agg(F.sqrt(F.min("cov")).alias("low"), F.sqrt(F.max("cov")).alias("high"))
    return _model_risks(t, models).join(bounds, ["as_of", "model"]).withColumn("slack", F.col("high") - F.col("risk"))


@query("JN12_scenario_grid", _MODELS + " FINAL SELECT rk.as_of, rk.model, multiple, cap, multiple * risk AS target FROM rk, (VALUES (0.9), (1.05), (1.2)) m(multiple), (VALUES (0.15), (0.2)) c(cap)", "multiple cap target")
def _(t: Tables) -> DataFrame:
    """Dates and models x risk multiples x caps: six stated scenarios a row."""
    grid = [t.spark.createDataFrame([(x,) for x in xs], f"{name} double") for name, xs in (("multiple", (0.9, 1.05, 1.2)), ("cap", (0.15, 0.2)))]
    scenarios = grid[0].crossJoin(grid[1])
    return _model_risks(t, _models(t)).crossJoin(F.broadcast(scenarios)).select("as_of", "model", "multiple", "cap", (F.col("multiple") * F.col("risk")).alias("target"))


# Guards that meet faults


@query("OPT12_faulty_covariances", _SAMPLE + """, bc AS (SELECT as_of, asset_i, asset_j, CASE WHEN month(as_of) = 1 AND asset_i = 'L1' AND asset_j = 'L2' THEN 'NaN'::DOUBLE WHEN month(as_of) = 4 AND asset_i = 'L2' AND asset_j = 'L1' THEN cov + 1e-6 ELSE cov END AS cov FROM cov WHERE NOT (month(as_of) = 7 AND asset_i = 'L3' AND asset_j = 'L4'))
FINAL SELECT as_of, count(DISTINCT asset_i) AS assets, count(*) AS cells, count(*) FILTER (isnan(cov)) AS not_finite, month(as_of) NOT IN (1, 4, 7) AS valid FROM bc GROUP BY 1""", ints="assets cells not_finite")
def _(t: Tables) -> DataFrame:
    """A missing number in January, an asymmetry in April, a missing cell in July."""
    month, i, j = F.month("as_of"), F.col("asset_i"), F.col("asset_j")
    cov = estimators.cov_sample(t.win, PER_YEAR, W).where(~((month == 7) & (i == "L3") & (j == "L4")))
    cell = F.when((month == 1) & (i == "L1") & (j == "L2"), float("nan")).when((month == 4) & (i == "L2") & (j == "L1"), F.col("cov") + 1e-6).otherwise(F.col("cov"))
    return estimators.covariance_faults(cov.withColumn("cov", cell)).select("as_of", "assets", "cells", "not_finite", "valid")


@query("PRJ19_found_by_guard", ", f AS (SELECT date, asset, CASE WHEN asset = 'L3' AND month(date) = 1 THEN 'Infinity'::DOUBLE WHEN asset = 'L5' AND month(date) = 2 THEN 'NaN'::DOUBLE WHEN asset = 'L6' AND month(date) = 3 THEN NULL ELSE ret END AS ret FROM raw_panel) FINAL SELECT asset, count(*) AS bad FROM f WHERE ret IS NULL OR isnan(ret) OR isinf(ret) GROUP BY 1", ints="bad")
def _(t: Tables) -> DataFrame:
    fault = lambda asset, month: (F.col("asset") == asset) & (F.month("date") == month)
    ret = F.when(fault("L3", 1), float("inf")).when(fault("L5", 2), float("nan")).when(fault("L6", 3), F.lit(None)).otherwise(F.col("ret"))
    return t.raw.withColumn("ret", ret).where(stats.null_if_not_finite(F.col("ret")).isNull()).groupBy("asset").agg(F.count("*").alias("bad"))


# Functions


@query("FN01_math", "SELECT date, asset, sqrt(abs(ret)) AS root, exp(ret) AS grown, ln(1 + ret) AS logged, pow(1 + ret, 52) AS year, greatest(least(ret, 0.001), -0.001) AS clipped, ceil(ret * 1e4) AS ceiling, CAST(day(date) AS INTEGER) % 7 AS modulo, isfinite(ret) AS finite, round(ret, 4) AS rounded FROM raw_panel", "root grown logged year clipped ceiling rounded", "modulo")
def _(t: Tables) -> DataFrame:
    r = F.col("ret")
    return t.raw.select("date", "asset", F.sqrt(F.abs(r)).alias("root"), F.exp(r).alias("grown"), F.log(1 + r).alias("logged"), F.pow(1 + r, F.lit(52.0)).alias("year"), F.greatest(F.least(r, F.lit(0.001)), F.lit(-0.001)).alias("clipped"), F.ceil(r * 1e4).cast("double").alias("ceiling"), (F.dayofmonth("date") % 7).alias("modulo"), stats.null_if_not_finite(r).isNotNull().alias("finite"), F.round(r, 4).alias("rounded"))


@query("FN02_half_life_decay", f"SELECT k, pow(2.0, -(51 - k) / {MEAN_HALF_LIFE}) / sum(pow(2.0, -(51 - k) / {MEAN_HALF_LIFE})) OVER () AS weight FROM (SELECT DISTINCT k FROM win)", "weight", "k")
def _(t: Tables) -> DataFrame:
    raw = stats.decayed(F.col("k"), W - 1, MEAN_HALF_LIFE)
    return t.win.select("k").distinct().withColumn("weight", raw).withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))  # a row a position of the window


@query("FN04_dates", "SELECT date, CAST(date_trunc('quarter', date) AS DATE) AS quarter, strftime(date, '%Y%m%d') AS compact, strftime(date, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(strptime(strftime(date, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS parsed, date < (SELECT median(pos) FROM cal) * INTERVAL 7 DAY + (SELECT min(date) FROM cal) AS early FROM cal")
def _(t: Tables) -> DataFrame:
    dates = t.panel.select("date").distinct()
    span = dates.agg(F.min("date").alias("low"), F.count("*").alias("n"))
    half = F.expr("timestampadd(SECOND, CAST((n - 1) / 2 * 604800 AS INT), CAST(low AS TIMESTAMP_NTZ))")
    return dates.crossJoin(F.broadcast(span)).select("date", F.trunc("date", "quarter").alias("quarter"), F.date_format("date", "yyyyMMdd").alias("compact"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.to_date(F.date_format("date", "dd/MM/yyyy"), "dd/MM/yyyy").alias("parsed"), (F.col("date").cast("timestamp_ntz") < half).alias("early"))  # span is one row


@query("FN05_arrays_and_maps", "SELECT as_of, string_agg(asset, ',' ORDER BY asset) AS assets, string_agg(CAST(r AS VARCHAR), ',' ORDER BY asset) AS places, max(CASE WHEN asset = 'L3' THEN r END) AS third FROM (SELECT as_of, asset, row_number() OVER (PARTITION BY as_of ORDER BY avg(ret) DESC, asset) - 1 AS r FROM win GROUP BY 1, 2) GROUP BY 1", ints="third")
def _(t: Tables) -> DataFrame:
    """Assets in order, each one's place by mean return, and a look-up in the map of places."""
    means = t.win.groupBy("as_of", "asset").agg(F.avg("ret").alias("m"))
    ranked = means.groupBy("as_of").agg(F.array_sort(F.collect_list("asset")).alias("names"), F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "asset"))).alias("order"))
    placed = ranked.withColumn("places", F.map_from_entries(F.transform("order", lambda x, i: F.struct(x["asset"], i))))
    return placed.select("as_of", F.array_join("names", ",").alias("assets"), F.array_join(F.transform("names", lambda a: F.element_at("places", a).cast("string")), ",").alias("places"), F.element_at("places", F.lit("L3")).alias("third"))


@query("FN06_canonical_json", """SELECT asset, json, sha256(json) AS digest FROM (SELECT asset, '{"asset":"' || asset || '","from":"' || strftime(min(date), '%Y-%m-%d') || '","skipped":null,"weeks":' || CAST(count(*) AS VARCHAR) || '}' AS json FROM panel GROUP BY asset)""")
def _(t: Tables) -> DataFrame:
    """Keys in order, no blanks, what is not a number as null, and the hash of that."""
    rows = t.panel.groupBy("asset").agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("from"), stats.null_if_not_finite(F.lit(float("nan"))).alias("skipped"), F.count("*").alias("weeks"))
    text = rows.select("asset", F.to_json(F.struct("asset", "from", "skipped", "weeks"), {"ignoreNullFields": "false"}).alias("json"))
    return text.withColumn("digest", F.sha2("json", 256))


@query("FN08_normal_distribution", """SELECT date, asset, z, 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))) AS probability
  FROM (SELECT date, asset, (ret - avg(ret) OVER w) / stddev_samp(ret) OVER w AS z FROM panel WINDOW w AS (PARTITION BY asset))""", "z probability")
def _(t: Tables) -> DataFrame:
    """The SQL adds up the same series with gamma functions; tests hold it to the standard library."""
    per = t.panel.groupBy("asset").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    z = (F.col("ret") - F.col("m")) / F.col("s")
    return t.panel.join(per, "asset").select("date", "asset", z.alias("z"), stats.normal_cdf(z).alias("probability"))


@query("FN09_annual_growth", "SELECT asset, pow(product(1 + ret), 52.0 / count(*)) - 1 AS cagr FROM panel GROUP BY 1", "cagr")
def _(t: Tables) -> DataFrame:
    return t.panel.groupBy("asset").agg(stats.cagr("ret", PER_YEAR).alias("cagr"))


# Covariance study

_ESTIMATES = {"sample": "EST05_cov_sample", "ewma": "EST06_cov_ewma", "iewma": "EST07_cov_iewma", "ledoit_wolf": "EST09_cov_ledoit_wolf"}
_ALL = " UNION ALL ".join(f"SELECT '{m}' AS method, as_of, sum(cov) AS s FROM ({ORACLE_SQL[q]}) GROUP BY 2" for m, q in _ESTIMATES.items())


@query("EST19_covariance_methods", f""", pred AS (SELECT method, as_of, sqrt(greatest(s / 49, 0)) AS predicted FROM ({_ALL})),
rl AS (SELECT as_of, stddev_samp(r) * sqrt(52) AS realized FROM (SELECT as_of, date, avg(ret) AS r FROM hold GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1)
FINAL SELECT method, count(*) AS periods, sqrt(avg((predicted - realized) ** 2)) AS rmse, avg(predicted - realized) AS bias, median(predicted) AS median_predicted FROM pred JOIN rl ON pred.as_of = rl.as_of GROUP BY 1""", "rmse bias median_predicted", "periods", digits=6)
def _(t: Tables) -> DataFrame:
    """Predicted against realized volatility of equal weights, by estimator."""
    eq = t.once(portfolio.equal_weight(t.win.select("as_of", "asset").distinct()))
    covs = _covariances(t)
    pred = reduce(DataFrame.unionByName, [estimators.quadratic_risk(eq, c, ["as_of"]).select(F.lit(m).alias("method"), "as_of", "risk") for m, c in covs.items()])
    real = t.hold.groupBy("as_of", "date").agg(F.avg("ret").alias("r")).groupBy("as_of").agg((F.stddev_samp("r") * F.sqrt(F.lit(52.0))).alias("realized"), F.count("*").alias("n")).where("n > 1")
    e = F.col("risk") - F.col("realized")
    return pred.join(real, "as_of").groupBy("method").agg(F.count("*").alias("periods"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.median("risk").alias("median_predicted"))
