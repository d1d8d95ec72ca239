"""Queries of estimators, portfolios, backtests, inference, robustness, regimes, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import asof, backtest, estimators, kernels, portfolio, regimes, resampling
from lodestrata.plans.base import CAP, COR_HALF_LIFE, MEAN_HALF_LIFE, PER_YEAR, SHRINK, TREND, VOL, VOL_HALF_LIFE, W, Tables, query
from lodestrata.sources import panels

COSTS = [0.0, 1.0, 5.0, 10.0, 25.0]
B_MEAN, B_VOL, B_COR = (2.0 ** (-1.0 / h) for h in (MEAN_HALF_LIFE, VOL_HALF_LIFE, COR_HALF_LIFE))

# Estimators

_MEANS = f""", m AS (SELECT as_of, asset, avg(ret) * 52 AS sample, sum(pow({B_MEAN!r}, 51 - k) * ret) / sum(pow({B_MEAN!r}, 51 - k)) * 52 AS ewma FROM win GROUP BY 1, 2),
mean AS (
  SELECT as_of, asset, 'sample' AS method, sample AS mu FROM m UNION ALL SELECT as_of, asset, 'ewma', ewma FROM m
  UNION ALL SELECT as_of, asset, 'shrink_zero', 0.5 * sample FROM m
  UNION ALL SELECT as_of, asset, 'shrink_grand_mean', 0.5 * sample + 0.5 * avg(sample) OVER (PARTITION BY as_of) FROM m)"""
_PAIRS = ", pr AS (SELECT a.as_of, a.k, a.asset AS asset_i, b.asset AS asset_j, a.ret AS x, b.ret AS y FROM win a JOIN win b ON a.as_of = b.as_of AND a.k = b.k)"
_SAMPLE = _PAIRS + ", cov AS (SELECT as_of, asset_i, asset_j, covar_samp(x, y) * 52 AS cov FROM pr GROUP BY 1, 2, 3)"
_VAR = f""", ev AS (
  SELECT as_of, asset, k, ret, pow({B_VOL!r}, k) * sum(CASE WHEN k = 0 THEN greatest(ret * ret, 1e-14) ELSE {1 - B_VOL!r} * ret * ret / pow({B_VOL!r}, k) END) OVER (PARTITION BY as_of, asset ORDER BY k) AS var
  FROM win)"""
_IEWMA = _VAR + f""", z AS (SELECT * FROM (SELECT as_of, asset, k, greatest(least(ret / sqrt(lag(var) OVER (PARTITION BY as_of, asset ORDER BY k)), 4.2), -4.2) AS z FROM ev) WHERE k > 0),
cc AS (SELECT a.as_of, a.asset AS i, b.asset AS j, sum({1 - B_COR!r} * pow({B_COR!r}, 51 - a.k) * a.z * b.z) + CASE WHEN a.asset = b.asset THEN pow({B_COR!r}, 51) ELSE 0 END AS c FROM z a JOIN z b ON a.as_of = b.as_of AND a.k = b.k GROUP BY a.as_of, a.asset, b.asset),
lv AS (SELECT as_of, asset, var FROM ev WHERE k = 51),
cov AS (
  SELECT cc.as_of, cc.i AS asset_i, cc.j AS asset_j, cc.c / sqrt(ci.c * cj.c) * sqrt(vi.var * vj.var) * 52 AS cov
  FROM cc JOIN cc ci ON ci.as_of = cc.as_of AND ci.i = cc.i AND ci.j = cc.i JOIN cc cj ON cj.as_of = cc.as_of AND cj.i = cc.j AND cj.j = cc.j
  JOIN lv vi ON vi.as_of = cc.as_of AND vi.asset = cc.i JOIN lv vj ON vj.as_of = cc.as_of AND vj.asset = cc.j)"""
_CORR = _PAIRS + ", co AS (SELECT as_of, asset_i, asset_j, greatest(least(corr(x, y), 1.0), -1.0) AS rho FROM pr GROUP BY 1, 2, 3), dist AS (SELECT as_of, asset_i, asset_j, rho, CASE WHEN asset_i = asset_j THEN 0.0 ELSE sqrt(greatest((1 - rho) / 2, 0.0)) END AS distance FROM co)"


def _means(t: Tables) -> DataFrame:
    return estimators.means(t.win, W, PER_YEAR, MEAN_HALF_LIFE, SHRINK)


def _iewma(t: Tables) -> DataFrame:
    return t.once(estimators.cov_iewma(t.win, W, PER_YEAR, VOL_HALF_LIFE, COR_HALF_LIFE))


@query("EST01_means", _MEANS + " FINAL SELECT * FROM mean", "mu")
def _(t: Tables) -> DataFrame:
    return _means(t)


@query("EST05_cov_sample", _SAMPLE + " FINAL SELECT * FROM cov", "cov", digits=10)
def _(t: Tables) -> DataFrame:
    return estimators.cov_sample(t.win, PER_YEAR, W)


@query("EST06_cov_ewma", _PAIRS + f", w AS (SELECT *, pow({B_VOL!r}, 51 - k) AS w FROM pr) FINAL SELECT as_of, asset_i, asset_j, (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) * 52 AS cov FROM w GROUP BY 1, 2, 3", "cov", digits=10)
def _(t: Tables) -> DataFrame:
    return estimators.cov_ewma(t.win, W, PER_YEAR, VOL_HALF_LIFE)


@query("WIN10_ew_variance", _VAR + " FINAL SELECT as_of, asset, k, var FROM ev", "var", "k", digits=12)
def _(t: Tables) -> DataFrame:
    return estimators.ew_variance(t.win, VOL_HALF_LIFE).select("as_of", "asset", "k", "var")


@query("EST07_cov_iewma", _IEWMA + " FINAL SELECT * FROM cov", "cov", digits=10)
def _(t: Tables) -> DataFrame:
    return _iewma(t)


@query("EST09_cov_ledoit_wolf", """, ce AS (SELECT as_of, k, asset, ret - avg(ret) OVER (PARTITION BY as_of, asset) AS r FROM win),
s AS (SELECT a.as_of, a.asset AS asset_i, b.asset AS asset_j, sum(a.r * b.r) / 52 AS s FROM ce a JOIN ce b ON a.as_of = b.as_of AND a.k = b.k GROUP BY 1, 2, 3),
n AS (SELECT as_of, sum(s * s) AS f2, sum(CASE WHEN asset_i = asset_j THEN s END) AS tr, CAST(count(DISTINCT asset_i) AS DOUBLE) AS n FROM s GROUP BY 1),
f AS (SELECT as_of, sum(q * q) AS q4 FROM (SELECT as_of, k, sum(r * r) AS q FROM ce GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT n.as_of, tr / n AS mu, (q4 / 52 - f2) / (n * 52) AS beta, (f2 - 2 * (tr / n) * tr + n * (tr / n) * (tr / n)) / n AS delta FROM n JOIN f ON n.as_of = f.as_of),
sh AS (SELECT as_of, mu, CASE WHEN delta > 0 THEN least(greatest(beta, 0), greatest(delta, 0)) / delta ELSE 0 END AS shrinkage FROM p)
FINAL SELECT s.as_of, asset_i, asset_j, shrinkage, ((1 - shrinkage) * s + shrinkage * CASE WHEN asset_i = asset_j THEN mu ELSE 0 END) * 52 AS cov FROM s JOIN sh ON s.as_of = sh.as_of""", "shrinkage cov")
def _(t: Tables) -> DataFrame:
    return estimators.cov_ledoit_wolf(t.win, W, PER_YEAR)


@query("EST10_repaired_covariance")
def _(t: Tables) -> DataFrame:
    return kernels.repaired(estimators.cov_sample(t.win, PER_YEAR, W))


_SEEDS = "SELECT as_of, 361 + CAST(strftime(as_of, '%Y%m%d') AS BIGINT) AS seed FROM sched"
_BLOCKS = resampling.block_sql(_SEEDS, "as_of", W, 8, 50)


def _seeds(t: Tables) -> DataFrame:
    return t.sched.select("as_of", (361 + F.date_format("as_of", "yyyyMMdd").cast("int")).alias("seed"))


@query("EST12_block_bootstrap_indices", _BLOCKS + " FINAL SELECT * FROM ix", ints="draw position source")
def _(t: Tables) -> DataFrame:
    return resampling.block_draws(_seeds(t), W, 8, 50)


@query("EST13_bootstrap_means", _BLOCKS + " FINAL SELECT ix.as_of, draw, asset, avg(ret) * 52 AS mu FROM ix JOIN win ON win.as_of = ix.as_of AND win.k = ix.source GROUP BY 1, 2, 3", "mu", "draw")
def _(t: Tables) -> DataFrame:
    drawn = resampling.block_draws(_seeds(t), W, 8, 50).withColumnRenamed("source", "k").join(t.win, ["as_of", "k"])
    return drawn.groupBy("as_of", "draw", "asset").agg((F.avg("ret") * PER_YEAR).alias("mu"))


def _uncertainty(t: Tables) -> DataFrame:
    return t.once(resampling.uncertainty(t.win, _seeds(t), W, PER_YEAR, 8, 200, 0.95, VOL_HALF_LIFE))


@query("EST14_uncertainty_calibration")
def _(t: Tables) -> DataFrame:
    return _uncertainty(t)


@query("EST15_date_seed", "SELECT as_of, 361 + CAST(strftime(as_of, '%Y%m%d') AS BIGINT) AS seed FROM sched", ints="seed")
def _(t: Tables) -> DataFrame:
    return _seeds(t)


def _evaluation(t: Tables) -> DataFrame:
    order = Window.partitionBy("as_of", "asset").orderBy("date")
    return t.hold.withColumn("k", F.row_number().over(order) - 1).select("as_of", "k", "asset", "ret")


@query("EST16_gaussian_loss")
def _(t: Tables) -> DataFrame:
    parts = []
    for name, cov in (("sample", estimators.cov_sample(t.win, PER_YEAR, W)), ("ewma", estimators.cov_ewma(t.win, W, PER_YEAR, VOL_HALF_LIFE)), ("iewma", _iewma(t)), ("ledoit_wolf", estimators.cov_ledoit_wolf(t.win, W, PER_YEAR))):
        parts.append(kernels.gaussian_loss(kernels.repaired(cov), _evaluation(t), PER_YEAR).withColumn("method", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query("EST17_spectrum")
def _(t: Tables) -> DataFrame:
    return kernels.diagnostics(kernels.repaired(_iewma(t)))


@query("EST18_quadratic_risk", _SAMPLE + " FINAL SELECT as_of, sqrt(greatest(sum(cov) / 49, 0)) AS risk FROM cov GROUP BY as_of", "risk")
def _(t: Tables) -> DataFrame:
    w = portfolio.equal_weight(t.win.select("as_of", "asset").distinct())
    return estimators.quadratic_risk(w, estimators.cov_sample(t.win, PER_YEAR, W), ["as_of"])


@query("EST19_covariance_study", _SAMPLE + """, pred AS (SELECT as_of, sqrt(greatest(sum(cov) / 49, 0)) AS predicted FROM cov GROUP BY as_of),
rl AS (SELECT as_of, stddev_samp(r) * sqrt(52) AS realized FROM (SELECT as_of, date, avg(ret) AS r FROM hold GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1)
FINAL SELECT 'sample' AS method, count(*) AS periods, sqrt(avg((predicted - realized) ** 2)) AS rmse, avg(predicted - realized) AS bias, median(predicted) AS median_predicted FROM pred JOIN rl ON pred.as_of = rl.as_of""", "rmse bias median_predicted", "periods")
def _(t: Tables) -> DataFrame:
    w = portfolio.equal_weight(t.win.select("as_of", "asset").distinct())
    pred = estimators.quadratic_risk(w, estimators.cov_sample(t.win, PER_YEAR, W), ["as_of"])
    real = t.hold.groupBy("as_of", "date").agg(F.avg("ret").alias("r")).groupBy("as_of").agg((F.stddev_samp("r") * F.sqrt(F.lit(52.0))).alias("realized"), F.count("*").alias("n")).where("n > 1")
    e = F.col("risk") - F.col("realized")
    return pred.join(real, "as_of").agg(F.count("*").alias("periods"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.median("risk").alias("median_predicted")).withColumn("method", F.lit("sample"))


# Portfolios

_SCORE = ", vol AS (SELECT as_of, asset_i AS asset, sqrt(cov) AS vol FROM cov WHERE asset_i = asset_j)"


def _water(name: str, score: str, source: str) -> str:
    """Capped proportional weights in closed form."""
    return f""", {name}_r AS (SELECT as_of, asset, {score} AS s, row_number() OVER (PARTITION BY as_of ORDER BY {score} DESC, asset) AS r FROM {source}),
{name}_t AS (SELECT *, sum(s) OVER (PARTITION BY as_of ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_r),
{name}_c AS (SELECT as_of, min(r) AS cut, arg_min(rest, r) AS rest FROM {name}_t WHERE (1 - (r - 1) * {CAP}) * s / rest <= {CAP} + 1e-15 GROUP BY 1),
{name} AS (SELECT a.as_of, a.asset, CASE WHEN c.cut IS NULL OR a.r < c.cut THEN {CAP} ELSE (1 - (c.cut - 1) * {CAP}) * a.s / c.rest END AS weight FROM {name}_t a LEFT JOIN {name}_c c ON a.as_of = c.as_of)"""


_INV = _IEWMA + _SCORE + _water("iv", "1.0 / vol", "vol")
_EQ = ", eq AS (SELECT as_of, asset, 1.0 / count(*) OVER (PARTITION BY as_of) AS weight FROM (SELECT DISTINCT as_of, asset FROM win))"
_CEQ = ", ceq AS (SELECT w.as_of, w.asset, 1.0 / (count(*) OVER (PARTITION BY w.as_of, asset_class) * (SELECT count(DISTINCT asset_class) FROM cls)) AS weight FROM (SELECT DISTINCT as_of, asset FROM win) w JOIN cls ON cls.asset = w.asset)"
_BOOKS = _INV + _EQ + _CEQ + ", book AS (SELECT 'equal' AS strategy, * FROM eq UNION ALL SELECT 'class_equal', * FROM ceq UNION ALL SELECT 'inverse_vol', * FROM iv)"


def _inverse(t: Tables) -> DataFrame:
    # an asset's correlation with itself is one: its cell needs no pairs
    var = estimators.last_ew_variance(t.win, ["as_of", "asset"], W, VOL_HALF_LIFE)
    return portfolio.inverse_volatility(var.select("as_of", "asset", F.sqrt(F.col("var") * PER_YEAR).alias("vol")), CAP)


def _books(t: Tables) -> DataFrame:
    assets = t.win.select("as_of", "asset").distinct()
    named = lambda df, n: df.withColumn("strategy", F.lit(n))
    return t.once(named(portfolio.equal_weight(assets), "equal").unionByName(named(portfolio.class_equal_weight(assets, t.cls), "class_equal")).unionByName(named(_inverse(t), "inverse_vol")))


@query("OPT01_equal_weight", _EQ + " FINAL SELECT * FROM eq", "weight")
def _(t: Tables) -> DataFrame:
    return portfolio.equal_weight(t.win.select("as_of", "asset").distinct(), CAP)


@query("OPT02_class_equal_weight", _CEQ + " FINAL SELECT * FROM ceq", "weight")
def _(t: Tables) -> DataFrame:
    return portfolio.class_equal_weight(t.win.select("as_of", "asset").distinct(), t.cls)


@query("OPT03_inverse_volatility", _INV + " FINAL SELECT * FROM iv", "weight")
def _(t: Tables) -> DataFrame:
    return _inverse(t)


@query("OPT04_water_fill", ", sc AS (SELECT as_of, asset, pow(CAST(substr(asset, 2) AS INTEGER), 3) AS s0 FROM (SELECT DISTINCT as_of, asset FROM win))" + _water("wf", "s0", "sc") + " FINAL SELECT * FROM wf", "weight")
def _(t: Tables) -> DataFrame:
    score = F.pow(F.substring("asset", 2, 9).cast("double"), 3.0)
    return portfolio.capped_proportional(t.win.select("as_of", "asset").distinct().withColumn("score", score), CAP)


@query("OPT06_risk_parity")
def _(t: Tables) -> DataFrame:
    return kernels.risk_parity_weights(kernels.repaired(_iewma(t)), CAP)


@query("OPT07_minimum_variance")
def _(t: Tables) -> DataFrame:
    return kernels.minimum_variance_weights(kernels.repaired(_iewma(t)), CAP)


def _scenarios(t: Tables, multiples: list[float], caps: list[float] = [CAP]) -> DataFrame:  # noqa: B006
    """One row a date, model, multiple and cap: what the solver needs, in asset order."""
    mu = _means(t).where("method = 'sample'").groupBy("as_of").agg(F.array_sort(F.collect_list(F.struct("asset", "mu"))).alias("m")).select("as_of", F.col("m.mu").alias("mu"))
    c = kernels.repaired(_iewma(t)).select("as_of", "assets", "c")
    u = _uncertainty(t).select("as_of", "se", "mean_cov", "box_rho", "ellipsoid_rho", "kappa")
    arr = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    full = c.join(mu, "as_of").join(u, "as_of").withColumn("model", arr(kernels.MODELS)).withColumn("multiple", arr(multiples)).withColumn("cap", arr(caps))
    full = full.withColumn("scenario", F.format_string("x%.2f_cap%.2f", "multiple", "cap"))
    return full.repartition("as_of", "model", "scenario")


@query("OPT08_robust_risk_ceiling", digits=5)
def _(t: Tables) -> DataFrame:
    return kernels.robust_weights(_scenarios(t, [0.9, 1.05, 1.2]))


@query("OPT13_box_return", _MEANS + _EQ + ", se AS (SELECT as_of, asset, stddev_samp(ret) * 52 / sqrt(52) AS se FROM win GROUP BY 1, 2) FINAL SELECT eq.as_of, sum(mu * weight) - 1.5 * sum(abs(se * weight)) AS box FROM eq JOIN mean ON mean.as_of = eq.as_of AND mean.asset = eq.asset AND method = 'sample' JOIN se ON se.as_of = eq.as_of AND se.asset = eq.asset GROUP BY 1", "box")
def _(t: Tables) -> DataFrame:
    se = t.win.groupBy("as_of", "asset").agg((F.stddev_samp("ret") * PER_YEAR / F.sqrt(F.lit(52.0))).alias("se"))
    eq = portfolio.equal_weight(t.win.select("as_of", "asset").distinct())
    j = eq.join(_means(t).where("method = 'sample'"), ["as_of", "asset"]).join(se, ["as_of", "asset"])
    return j.groupBy("as_of").agg(portfolio.box_return(F.col("mu"), F.col("weight"), F.col("se"), 1.5).alias("box"))


@query("OPT14_ellipsoid_return", _MEANS + _SAMPLE.replace(_PAIRS, _PAIRS) + _EQ + " FINAL SELECT e.as_of, e.m - 1.5 * r.risk AS ellipsoid FROM (SELECT eq.as_of, sum(mu * weight) AS m FROM eq JOIN mean ON mean.as_of = eq.as_of AND mean.asset = eq.asset AND method = 'sample' GROUP BY 1) e JOIN (SELECT as_of, sqrt(greatest(sum(cov) / 49 / 52, 0)) AS risk FROM cov GROUP BY 1) r ON r.as_of = e.as_of", "ellipsoid")
def _(t: Tables) -> DataFrame:
    eq = portfolio.equal_weight(t.win.select("as_of", "asset").distinct())
    cov = estimators.cov_sample(t.win, PER_YEAR, W).withColumn("cov", F.col("cov") / 52)
    m = eq.join(_means(t).where("method = 'sample'"), ["as_of", "asset"]).groupBy("as_of").agg(F.sum(F.col("mu") * F.col("weight")).alias("m"))
    return m.join(estimators.quadratic_risk(eq, cov, ["as_of"]), "as_of").select("as_of", (F.col("m") - 1.5 * F.col("risk")).alias("ellipsoid"))


@query("OPT15_diagonal_robust", _SAMPLE + " FINAL SELECT as_of, asset_i, asset_j, cov * CASE WHEN asset_i = asset_j THEN 1.3 ELSE 1 END AS cov FROM cov", "cov", digits=10)
def _(t: Tables) -> DataFrame:
    return portfolio.diagonal_robust(estimators.cov_sample(t.win, PER_YEAR, W), 0.3)


@query("OPT17_risk_attainment", digits=5)
def _(t: Tables) -> DataFrame:
    return kernels.attainment(_scenarios(t, [0.9, 1.2]))


@query("PRJ20_weight_validity", _BOOKS + " FINAL SELECT strategy, as_of, sum(weight) - 1 AS sum_residual, greatest(-min(weight), 0.0) AS lower_violation, greatest(max(weight) - 0.2, 0.0) AS cap_violation, abs(sum(weight) - 1) <= 5e-7 AND greatest(max(weight) - 0.2, 0.0) <= 5e-7 AS valid FROM book GROUP BY 1, 2", "sum_residual lower_violation cap_violation")
def _(t: Tables) -> DataFrame:
    return portfolio.weights_ok(_books(t), ["strategy", "as_of"], CAP)


# Backtests

_GROW = ", gr AS (SELECT as_of, asset, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY as_of, asset ORDER BY date)) AS growth FROM hold), bg AS (SELECT strategy, b.as_of, date, sum(weight * growth) AS growth FROM book b JOIN gr ON gr.as_of = b.as_of AND gr.asset = b.asset GROUP BY 1, 2, 3)"
_EXEC = """, ed AS (SELECT as_of, asset, arg_max(growth, date) AS g FROM gr GROUP BY 1, 2),
dr AS (SELECT strategy, s.next_as_of AS as_of, b.asset, weight * g / sum(weight * g) OVER (PARTITION BY strategy, b.as_of) AS drifted FROM book b JOIN ed ON ed.as_of = b.as_of AND ed.asset = b.asset JOIN sched s ON s.as_of = b.as_of WHERE s.next_as_of IS NOT NULL),
ex AS (SELECT b.strategy, b.as_of, b.asset, b.weight, coalesce(dr.drifted, 0) AS drifted, b.as_of = (SELECT min(as_of) FROM sched) AS is_initial FROM book b LEFT JOIN dr ON dr.strategy = b.strategy AND dr.as_of = b.as_of AND dr.asset = b.asset)"""
_STEPS = ", ph0 AS (SELECT DISTINCT strategy, as_of, cost_bps, 1.0 AS phi FROM ex, (VALUES (0.0), (1.0), (5.0), (10.0), (25.0)) c(cost_bps))" + "".join(f", ph{i} AS (SELECT p.strategy, p.as_of, p.cost_bps, 1 - p.cost_bps / 10000 * sum(abs(weight * phi - drifted)) AS phi FROM ph{i - 1} p JOIN ex ON ex.strategy = p.strategy AND ex.as_of = p.as_of GROUP BY p.strategy, p.as_of, p.cost_bps)" for i in range(1, 9))
_PATHS = _GROW + _EXEC + _STEPS + """, lv2 AS (
  SELECT p.strategy, p.as_of, p.cost_bps, p.phi, coalesce(exp(sum(ln(e.g)) OVER (PARTITION BY p.strategy, p.cost_bps ORDER BY p.as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS gross0,
    exp(sum(ln(p.phi)) OVER (PARTITION BY p.strategy, p.cost_bps ORDER BY p.as_of)) AS cum
  FROM ph8 p JOIN (SELECT strategy, as_of, arg_max(growth, date) AS g FROM bg GROUP BY 1, 2) e ON e.strategy = p.strategy AND e.as_of = p.as_of),
raw_path AS (
  SELECT l.strategy, l.cost_bps, bg.date, gross0 * growth AS gross_wealth, gross0 * cum * growth AS net_wealth FROM lv2 l JOIN bg ON bg.strategy = l.strategy AND bg.as_of = l.as_of
  UNION ALL SELECT strategy, cost_bps, as_of, 1.0, phi FROM lv2 WHERE as_of = (SELECT min(as_of) FROM sched)),
path0 AS (
  SELECT r.strategy, r.cost_bps, r.date, gross_wealth, coalesce(1 - l.phi, 0) AS transaction_cost,
    CASE WHEN l.phi IS NULL OR r.date = (SELECT min(as_of) FROM sched) THEN net_wealth ELSE net_wealth * l.phi END AS net_wealth
  FROM raw_path r LEFT JOIN lv2 l ON l.strategy = r.strategy AND l.cost_bps = r.cost_bps AND l.as_of = r.date),
path AS (
  SELECT *, gross_wealth / coalesce(lag(gross_wealth) OVER w, 1.0) - 1 AS gross_return, net_wealth / coalesce(lag(net_wealth) OVER w, 1.0) - 1 AS net_return
  FROM path0 WINDOW w AS (PARTITION BY strategy, cost_bps ORDER BY date))"""
_METRICS = """, dd AS (SELECT *, net_wealth / max(net_wealth) OVER w - 1 AS dn, gross_wealth / max(gross_wealth) OVER w - 1 AS dg FROM path WINDOW w AS (PARTITION BY strategy, cost_bps ORDER BY date)),
met AS (
  SELECT strategy, cost_bps, count(*) AS days, arg_max(gross_wealth, date) AS final_gross_wealth, arg_max(net_wealth, date) AS final_net_wealth,
    pow(product(1 + gross_return), 52.0 / count(*)) - 1 AS gross_annualized_return, pow(product(1 + net_return), 52.0 / count(*)) - 1 AS net_annualized_return,
    stddev_samp(gross_return) * sqrt(52) AS gross_volatility, stddev_samp(net_return) * sqrt(52) AS net_volatility,
    CASE WHEN stddev_samp(net_return) > 0 THEN avg(net_return) * 52 / (stddev_samp(net_return) * sqrt(52)) END AS net_sharpe,
    min(dg) AS gross_max_drawdown, min(dn) AS net_max_drawdown, sum(transaction_cost) AS total_cost
  FROM dd GROUP BY 1, 2)"""
_MET_DOUBLES = "cost_bps final_gross_wealth final_net_wealth gross_annualized_return net_annualized_return gross_volatility net_volatility net_sharpe gross_max_drawdown net_max_drawdown total_cost"


def _costs(t: Tables, bps: list[float] = COSTS) -> DataFrame:  # noqa: B006
    return t.spark.createDataFrame([(float(b),) for b in bps], "cost_bps double")


def _paths(t: Tables, bps: list[float] = COSTS) -> DataFrame:  # noqa: B006
    return t.once(backtest.wealth(_books(t), t.panel, t.sched, _costs(t, bps), t.once))


def _execs(t: Tables) -> DataFrame:
    return backtest.executions(_books(t), backtest.asset_growth(t.panel, t.sched), t.sched)


@query("flagship_backtest", _BOOKS + _PATHS + _METRICS + " FINAL SELECT * FROM met", _MET_DOUBLES, "days")
def _(t: Tables) -> DataFrame:
    return backtest.metrics(backtest.wealth(_books(t), t.panel, t.sched, _costs(t), t.once), PER_YEAR)


@query("BT01_drifted_growth", _BOOKS + _GROW + " FINAL SELECT * FROM bg", "growth")
def _(t: Tables) -> DataFrame:
    return backtest.book_growth(_books(t), backtest.asset_growth(t.panel, t.sched))


@query("BT02_turnover", _BOOKS + _GROW + _EXEC + " FINAL SELECT strategy, as_of, is_initial, sum(abs(weight - drifted)) AS gross_turnover, sum(abs(weight - drifted)) / 2 AS one_way_turnover FROM ex GROUP BY 1, 2, 3", "gross_turnover one_way_turnover")
def _(t: Tables) -> DataFrame:
    return backtest.turnovers(_execs(t))


@query("BT06_cost_factor", _BOOKS + _GROW + _EXEC + _STEPS + " FINAL SELECT strategy, as_of, cost_bps, phi FROM ph8", "cost_bps phi", digits=10)
def _(t: Tables) -> DataFrame:
    return backtest.cost_factors(_execs(t), _costs(t)).select("strategy", "as_of", "cost_bps", "phi")


@query("BT07_executions", _BOOKS + _GROW + _EXEC + " FINAL SELECT * FROM ex", "weight drifted")
def _(t: Tables) -> DataFrame:
    return _execs(t)


@query("BT10_ledger", _BOOKS + _PATHS + " FINAL SELECT p.strategy, p.cost_bps, p.date, coalesce(lag(net_wealth) OVER (PARTITION BY p.strategy, p.cost_bps ORDER BY p.date), 1.0) AS start_nav, net_wealth / (1 - transaction_cost) AS pre_trade_nav, net_wealth / (1 - transaction_cost) * transaction_cost AS cost, net_wealth AS end_nav, s.as_of IS NOT NULL AS executed FROM path p LEFT JOIN sched s ON s.as_of = p.date WHERE cost_bps = 5", "cost_bps start_nav pre_trade_nav cost end_nav")
def _(t: Tables) -> DataFrame:
    return backtest.ledger(_paths(t, [5.0]), t.sched)


@query("BT11_simulation", _BOOKS + _PATHS + " FINAL SELECT strategy, cost_bps, date, gross_wealth, net_wealth, gross_return, net_return, transaction_cost FROM path", "cost_bps gross_wealth net_wealth gross_return net_return transaction_cost")
def _(t: Tables) -> DataFrame:
    return _paths(t)


# Inference

_SERIES = ", ser AS (SELECT asset AS strategy, pos, ret FROM panel JOIN cal ON cal.date = panel.date)"


#: Resampling of whole series: draws, expected run, seed.
DRAWS, RUN, SEED = 100, 10, 36129


def draws_sql(rows: str) -> str:
    """ix: draw, position, source, run; rows is a query of one number n, how many rows are drawn from."""
    return resampling.stationary_sql(rows, RUN, DRAWS, SEED)


def draws(t: Tables, rows: int) -> DataFrame:
    return resampling.stationary_draws(t.spark, rows, RUN, DRAWS, SEED)


_DRAWS = draws_sql("SELECT max(pos) + 1 AS n FROM ser")
_REP = _SERIES + _DRAWS + ", st AS (SELECT draw, strategy, avg(ret) * 52 AS mean, stddev_samp(ret) * sqrt(52) AS volatility FROM ix JOIN ser ON ser.pos = ix.source GROUP BY 1, 2), rep AS (SELECT *, CASE WHEN volatility > 0 THEN mean / volatility END AS sharpe, mean - 1.5 * volatility * volatility AS ce FROM st)"


def _series(t: Tables) -> DataFrame:
    return t.once(t.panel.join(asof.calendar(t.panel), "date").select(F.col("asset").alias("strategy"), "pos", "ret"))


def _length(series: DataFrame) -> int:
    """Rows of the longest series; 1 if there are none."""
    return series.agg(F.coalesce(F.max("pos"), F.lit(0)) + 1).first()[0]


def _rep(t: Tables) -> DataFrame:
    series = _series(t)
    return t.once(resampling.replicate_statistics(series, draws(t, _length(series)), PER_YEAR, 3.0))


@query("INF01_stationary_indices", _SERIES + _DRAWS + " FINAL SELECT strategy, draw, count(*) AS positions, count(DISTINCT run) AS runs, avg(ret) AS mean FROM ix JOIN ser ON ser.pos = ix.source GROUP BY 1, 2", "mean", "draw positions runs")
def _(t: Tables) -> DataFrame:
    series = _series(t)
    met = draws(t, _length(series)).join(series, F.col("source") == F.col("pos"))
    return met.groupBy("strategy", "draw").agg(F.count("*").alias("positions"), F.sum((F.col("position") == F.col("run")).cast("int")).alias("runs"), F.avg("ret").alias("mean"))


@query("INF01_index_matrix", _SERIES + _DRAWS + " FINAL SELECT draw, position, source, run FROM ix", ints="draw position source run")
def _(t: Tables) -> DataFrame:
    """The matrix itself, all draws of the whole series."""
    return draws(t, _length(_series(t)))


@query("INF02_replicates", _REP + " FINAL SELECT * FROM rep", "mean volatility sharpe ce", "draw")
def _(t: Tables) -> DataFrame:
    return _rep(t)


@query("INF03_intervals", _REP + " FINAL SELECT strategy, metric, quantile_cont(value, 0.025) AS ci_lower, quantile_cont(value, 0.975) AS ci_upper FROM (UNPIVOT rep ON mean, volatility, sharpe, ce INTO NAME metric VALUE value) GROUP BY 1, 2", "ci_lower ci_upper")
def _(t: Tables) -> DataFrame:
    return resampling.intervals(_rep(t), 0.95)


@query("INF04_paired_intervals", _REP + ", df AS (SELECT a.draw, a.strategy, a.sharpe - b.sharpe AS sharpe, a.ce - b.ce AS ce FROM rep a JOIN rep b ON a.draw = b.draw AND b.strategy = 'L1' WHERE a.strategy <> 'L1') FINAL SELECT strategy, metric, quantile_cont(value, 0.025) AS ci_lower, quantile_cont(value, 0.975) AS ci_upper FROM (UNPIVOT df ON sharpe, ce INTO NAME metric VALUE value) GROUP BY 1, 2", "ci_lower ci_upper")
def _(t: Tables) -> DataFrame:
    return resampling.paired_intervals(_rep(t), "L1", 0.95)


def cdf_sql(z: str) -> str:
    """Phi as a DuckDB expression: its series by gamma functions."""
    return f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda j: exp((2 * j + 1) * ln(greatest(abs({z}), 1e-300)) - (j + 1) * ln(2) - lgamma(j + 1.5) + 0.5 * ln(pi())))))"


def quantile_sql(p: str) -> str:
    """Phi's inverse above 1/2 as a DuckDB expression, by Newton's steps."""
    return f"list_reduce(list_transform(range(0, 60), lambda i: CAST(0 AS DOUBLE)), lambda q, i: q - ({cdf_sql('q')} - ({p})) / (exp(-q * q / 2) / sqrt(2 * pi())), CAST(0 AS DOUBLE))"


def deflated_sql(series: str) -> str:
    """dsr: the deflated Sharpe ratios of series, a query of strategy, ret."""
    g, root = resampling.EULER_GAMMA, "sqrt(52)"
    return f""", d0 AS (SELECT strategy, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt, count(*) AS n FROM ({series}) GROUP BY 1),
d1 AS (SELECT count(*) AS trials, stddev_samp(sr * {root}) AS spread FROM d0),
d2 AS (SELECT trials, spread * ({1 - g!r} * {quantile_sql("1 - 1 / trials")} + {g!r} * {quantile_sql("1 - 1 / (trials * exp(1))")}) AS expected_max FROM d1),
d3 AS (SELECT strategy, sr * {root} AS sharpe, skew, kurt, trials, expected_max, (sr - expected_max / {root}) * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-16)) AS z FROM d0, d2),
dsr AS (SELECT *, {cdf_sql("least(greatest(z, -8.0), 8.0)")} AS probability FROM d3)"""


_DEFLATED = deflated_sql("SELECT asset AS strategy, ret FROM panel")


@query("INF05_deflated_sharpe", _DEFLATED + " FINAL SELECT * EXCLUDE (probability) FROM dsr", "sharpe skew kurt expected_max z", "trials", digits=6)
def _(t: Tables) -> DataFrame:
    return resampling.deflated_sharpe(t.panel.select(F.col("asset").alias("strategy"), "ret"), PER_YEAR).drop("probability")


@query("INF05_deflated_sharpe_probability", _DEFLATED + " FINAL SELECT * FROM dsr", "sharpe skew kurt expected_max z probability", "trials", digits=6)
def _(t: Tables) -> DataFrame:
    return resampling.deflated_sharpe(t.panel.select(F.col("asset").alias("strategy"), "ret"), PER_YEAR)


# Robustness and clusters


@query("ROB01_allocation_diagnostics", _INV + _EQ + " FINAL SELECT as_of, sum(abs(b - a)) AS l1, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS cosine, sum(a * a) AS hhi_a, sum(b * b) AS hhi_b, 1 / sum(a * a) AS effective_a, 1 / sum(b * b) AS effective_b FROM (SELECT eq.as_of, eq.weight AS a, iv.weight AS b FROM eq JOIN iv ON iv.as_of = eq.as_of AND iv.asset = eq.asset) GROUP BY 1", "l1 cosine hhi_a hhi_b effective_a effective_b")
def _(t: Tables) -> DataFrame:
    eq = portfolio.equal_weight(t.win.select("as_of", "asset").distinct())
    return portfolio.allocation_diagnostics(eq, _inverse(t), ["as_of"])


@query("ROB02_class_change", _INV + _EQ + ", xx AS (SELECT eq.as_of, asset_class, sum(iv.weight) - sum(eq.weight) AS d FROM eq JOIN iv ON iv.as_of = eq.as_of AND iv.asset = eq.asset JOIN cls ON cls.asset = eq.asset GROUP BY 1, 2) FINAL SELECT as_of, sum(abs(d)) AS exposure_l1 FROM xx GROUP BY 1", "exposure_l1")
def _(t: Tables) -> DataFrame:
    eq = portfolio.equal_weight(t.win.select("as_of", "asset").distinct())
    return portfolio.exposure_change(eq, _inverse(t), t.cls, ["as_of"], "asset_class")


@query("ROB03_covariance_shocks", _SAMPLE + " FINAL SELECT 'variance' AS shock, as_of, asset_i, asset_j, cov * 1.1 AS cov FROM cov UNION ALL SELECT 'correlation', as_of, asset_i, asset_j, cov * CASE WHEN asset_i = asset_j THEN 1 ELSE 0.9 END FROM cov", "cov", digits=10)
def _(t: Tables) -> DataFrame:
    cov = estimators.cov_sample(t.win, PER_YEAR, W)
    mixed = F.col("cov") * F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(0.9)
    return cov.withColumn("cov", F.col("cov") * 1.1).withColumn("shock", F.lit("variance")).unionByName(cov.withColumn("cov", mixed).withColumn("shock", F.lit("correlation")))


@query("ROB03_eigenvalue_shock")
def _(t: Tables) -> DataFrame:
    return kernels.diagnostics(kernels.eigen_shock(kernels.repaired(_iewma(t))))


@query("ROB05_direct_robustness", digits=5)
def _(t: Tables) -> DataFrame:
    """Means one standard error up and down: distance of each model's weights to its own."""
    s = _scenarios(t, [1.2])
    shift = F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0)))
    moved = s.withColumn("shift", shift).withColumn("mu", F.zip_with("mu", F.transform("se", lambda x: x * F.col("shift")), lambda m, d: m + d)).withColumn("scenario", F.col("shift").cast("string")).drop("shift")
    w = kernels.robust_weights(moved).where("asset IS NOT NULL").select("as_of", "model", "scenario", "asset", "weight")
    base = w.where("scenario = '0.0'").drop("scenario")
    other = w.where("scenario != '0.0'")
    kinds = other.select("as_of", "model", "scenario").distinct()
    return portfolio.allocation_diagnostics(base.join(kinds, ["as_of", "model"]), other, ["as_of", "model", "scenario"])


@query("ROB06_fold_clone", _EQ + " FINAL SELECT as_of, CASE WHEN asset = 'L7' THEN 'L1' ELSE asset END AS asset, sum(weight) AS weight FROM eq GROUP BY 1, 2", "weight")
def _(t: Tables) -> DataFrame:
    return portfolio.fold_clone(portfolio.equal_weight(t.win.select("as_of", "asset").distinct()), "L7", "L1", ["as_of"])


@query("ROB09_sensitivity_caps", digits=5)
def _(t: Tables) -> DataFrame:
    w = kernels.robust_weights(_scenarios(t, [1.2], [0.16, 0.2, 0.4]))
    return w.groupBy("model", "scenario").agg(F.count("weight").alias("rows"), F.sum((F.col("status") != "OPTIMAL").cast("int")).alias("failures"), F.avg("base_vol").alias("base_vol"))


@query("CLU01_correlation_distance", _CORR + " FINAL SELECT * FROM dist", "rho distance", digits=6)
def _(t: Tables) -> DataFrame:
    return estimators.correlation(t.win, W)


def _clusters(t: Tables) -> DataFrame:
    panel = panels.complete_dates(t.wide)
    win = asof.training_windows(panel, asof.quarter_schedule(panel, W), W)
    return kernels.clusters(estimators.correlation(win, W).select("as_of", "asset_i", "asset_j", "distance"), [0.05, 0.1, 0.2, 0.4])


@query("CLU02_average_linkage")
def _(t: Tables) -> DataFrame:
    return _clusters(t)


def _medoids(t: Tables) -> DataFrame:
    """The member with the least mean distance in its cluster; ties within 1e-14 by name."""
    panel = panels.complete_dates(t.wide)
    win = asof.training_windows(panel, asof.quarter_schedule(panel, W), W)
    d = estimators.correlation(win, W).select("as_of", "asset_i", "asset_j", "distance")
    c = _clusters(t)
    left = c.withColumnRenamed("asset", "asset_i")
    right = c.select("as_of", "threshold", F.col("asset").alias("asset_j"), "cluster")
    mean = left.join(d, ["as_of", "asset_i"]).join(right, ["as_of", "threshold", "cluster", "asset_j"]).groupBy("as_of", "threshold", "cluster", "asset_i").agg(F.avg("distance").alias("m"))
    least = mean.withColumn("least", F.min("m").over(Window.partitionBy("as_of", "threshold", "cluster"))).where("m <= least + 1e-14")
    return least.groupBy("as_of", "threshold", "cluster").agg(F.min("asset_i").alias("medoid"))


@query("CLU03_medoids")
def _(t: Tables) -> DataFrame:
    return _medoids(t)


# Regimes

_REG = f""", ft AS (
  SELECT date, CASE WHEN count(*) OVER t = {TREND} THEN exp(sum(ln(1 + ret)) OVER t) - 1 END AS trend, CASE WHEN count(*) OVER v = {VOL} THEN stddev_samp(ret) OVER v * sqrt(52) END AS rv
  FROM mkt WINDOW t AS (ORDER BY date ROWS BETWEEN {TREND} PRECEDING AND 1 PRECEDING), v AS (ORDER BY date ROWS BETWEEN {VOL - 1} PRECEDING AND CURRENT ROW)),
fv AS (SELECT date, trend, last_value(rv IGNORE NULLS) OVER p AS latest_vol, quantile_cont(rv, 0.5) OVER p AS vol_threshold FROM ft WINDOW p AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rg AS (
  SELECT s.as_of, trend, latest_vol, vol_threshold, CASE WHEN trend > 0 AND latest_vol <= vol_threshold THEN 'CALM_GROWTH' WHEN trend > 0 THEN 'VOLATILE_GROWTH' WHEN latest_vol <= vol_threshold THEN 'WEAK_MARKET' ELSE 'STRESS' END AS regime
  FROM sched s JOIN fv ON fv.date = s.as_of WHERE trend IS NOT NULL AND latest_vol IS NOT NULL)"""


def _regimes(t: Tables) -> DataFrame:
    return regimes.classify(t.mkt, t.sched, TREND, VOL, PER_YEAR)


@query("REG01_regimes", _REG + " FINAL SELECT * FROM rg", "trend latest_vol vol_threshold")
def _(t: Tables) -> DataFrame:
    return _regimes(t)


@query("REG02_regime_summary", _BOOKS + _PATHS + _REG + """, rr AS (SELECT p.strategy, rg.regime, p.net_return FROM path p JOIN (SELECT DISTINCT as_of, date FROM hold) h ON h.date = p.date JOIN rg ON rg.as_of = h.as_of WHERE cost_bps = 5),
gg AS (SELECT s.strategy, r.regime FROM (SELECT DISTINCT strategy FROM book) s, (VALUES ('CALM_GROWTH'), ('VOLATILE_GROWTH'), ('WEAK_MARKET'), ('STRESS')) r(regime)),
ss AS (SELECT strategy, regime, count(*) AS n, avg(net_return) * 52 AS m, stddev_samp(net_return) * sqrt(52) AS v FROM rr GROUP BY 1, 2)
FINAL SELECT gg.strategy, gg.regime, coalesce(n, 0) AS rows, m AS mean_return, v AS volatility, CASE WHEN v > 0 THEN m / v END AS sharpe, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_OBSERVATIONS' WHEN n < 26 THEN 'FEW_OBSERVATIONS' END AS warning FROM gg LEFT JOIN ss ON ss.strategy = gg.strategy AND ss.regime = gg.regime""", "mean_return volatility sharpe", "rows")
def _(t: Tables) -> DataFrame:
    held = t.hold.select("date", "as_of").distinct()
    return regimes.summary(_paths(t, [5.0]).select("strategy", "date", "net_return"), held, _regimes(t), PER_YEAR, 26)


# Tables


@query("RISK01_ceiling_diagnostics", digits=5)
def _(t: Tables) -> DataFrame:
    w = kernels.robust_weights(_scenarios(t, [0.9, 1.05, 1.2]))
    one = w.groupBy("as_of", "model", "scenario").agg(F.first("ceiling").alias("ceiling"), F.first("base_vol").alias("base_vol"), F.first("status").alias("status"), F.first("message").alias("message"))
    return one.withColumns({"slack": F.col("ceiling") - F.col("base_vol"), "binding": F.col("message") == "binding"})


@query("TAB02_headline_table", _BOOKS + _PATHS + _METRICS + ", h5 AS (SELECT * FROM met WHERE cost_bps = 5) FINAL SELECT strategy, list_position(['inverse_vol', 'equal', 'class_equal'], strategy) AS place, net_annualized_return, net_volatility, net_sharpe, net_sharpe - (SELECT net_sharpe FROM h5 WHERE strategy = 'equal') AS delta_sharpe FROM h5", "net_annualized_return net_volatility net_sharpe delta_sharpe", "place")
def _(t: Tables) -> DataFrame:
    m = backtest.metrics(_paths(t, [5.0]), PER_YEAR)
    base = m.where("strategy = 'equal'").select(F.col("net_sharpe").alias("s0"))
    place = F.array_position(F.array(*map(F.lit, ("inverse_vol", "equal", "class_equal"))), F.col("strategy"))
    return m.join(F.broadcast(base)).select("strategy", place.alias("place"), "net_annualized_return", "net_volatility", "net_sharpe", (F.col("net_sharpe") - F.col("s0")).alias("delta_sharpe"))  # base is one row


@query("TAB05_failure_ledger", digits=5)
def _(t: Tables) -> DataFrame:
    w = kernels.robust_weights(_scenarios(t, [0.9]))
    a = kernels.attainment(_scenarios(t, [0.9]))
    failed = w.where("status != 'OPTIMAL'").select("as_of", "model", "status", "message", F.lit("ceiling").alias("experiment"))
    missed = a.where("status != 'ATTAINED'").select("as_of", "model", "status", F.col("reason").alias("message"), F.lit("attainment").alias("experiment"))
    return failed.unionByName(missed)
