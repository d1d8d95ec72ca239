"""Further queries: joins, windows and sets by their own names, guards, tables, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.stats import decayed
from lodestrata.operators import asof, backtest, estimators, gram, kernels, policies, portfolio
from lodestrata.plans.base import CAP, MEAN_HALF_LIFE, PER_YEAR, VOL, W, Tables, query
from lodestrata.plans.config import complete_strategies
from lodestrata.plans.research import _BOOKS, _CORR, _EQ, _GROW, _INV, _MEANS, _MET_DOUBLES, _METRICS, _PATHS, _books, _clusters, _execs, _inverse, _means, _paths, _scenarios
from lodestrata.sources import panels


@query("PRJ02_column_subset", "SELECT date, asset, ret FROM panel WHERE asset IN ('L2', 'L5')", "ret")
def _(t: Tables) -> DataFrame:
    return asof.before(t.panel, "9999-01-01", ["L2", "L5"])


@query("PRJ16_case_labels", "SELECT date, asset, CASE WHEN ret > 0.005 THEN 'UP' WHEN ret < -0.005 THEN 'DOWN' ELSE 'FLAT' END AS label FROM panel")
def _(t: Tables) -> DataFrame:
    r = F.col("ret")
    return t.panel.select("date", "asset", F.when(r > 0.005, "UP").when(r < -0.005, "DOWN").otherwise("FLAT").alias("label"))


@query("PRJ18_complete_strategies", _BOOKS + " FINAL SELECT strategy FROM book WHERE strategy <> 'equal' GROUP BY strategy HAVING count(DISTINCT as_of) = (SELECT count(*) FROM sched)")
def _(t: Tables) -> DataFrame:
    failed = t.spark.createDataFrame([("equal",)], "strategy string")
    return complete_strategies(_books(t), t.sched, failed)


@query("PRJ25_ineligible_targets", _EQ + " FINAL SELECT eq.as_of, eq.asset, weight FROM eq WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.as_of = eq.as_of AND w.asset = eq.asset AND w.asset <> 'L4')", "weight")
def _(t: Tables) -> DataFrame:
    eligible = t.win.where("asset != 'L4'").select("as_of", "asset").distinct()
    return portfolio.equal_weight(t.win.select("as_of", "asset").distinct()).join(eligible, ["as_of", "asset"], "left_anti")


@query("PRJ26_schedule_without_rows", "SELECT d AS as_of FROM (SELECT as_of + INTERVAL 1 DAY AS d0, CAST(as_of + INTERVAL 1 DAY AS DATE) AS d FROM sched) WHERE d NOT IN (SELECT date FROM panel)")
def _(t: Tables) -> DataFrame:
    moved = t.sched.select(F.date_add("as_of", 1).alias("date"))
    return moved.join(t.panel.select("date").distinct(), "date", "left_anti").select(F.col("date").alias("as_of"))


@query("JN01_left_align", "SELECT c.asset, coalesce(n, 0) AS n FROM cls c LEFT JOIN (SELECT asset, count(*) AS n FROM panel WHERE ret > 0 AND asset <> 'L3' GROUP BY 1) p ON p.asset = c.asset", ints="n")
def _(t: Tables) -> DataFrame:
    n = t.panel.where("ret > 0 AND asset != 'L3'").groupBy("asset").agg(F.count("*").alias("n"))
    return t.cls.select("asset").join(n, "asset", "left").fillna(0, ["n"])


@query("JN05_composite_left_join", ", a AS (SELECT as_of, asset, avg(ret) AS train FROM win GROUP BY 1, 2), b AS (SELECT as_of, asset, avg(ret) AS held FROM hold GROUP BY 1, 2) FINAL SELECT a.as_of, a.asset, train, held FROM a LEFT JOIN b ON a.as_of = b.as_of AND a.asset = b.asset", "train held")
def _(t: Tables) -> DataFrame:
    a = t.win.groupBy("as_of", "asset").agg(F.avg("ret").alias("train"))
    return a.join(t.hold.groupBy("as_of", "asset").agg(F.avg("ret").alias("held")), ["as_of", "asset"], "left")


@query("JN11_interval_join", "SELECT as_of, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date FROM hold GROUP BY 1", ints="dates")
def _(t: Tables) -> DataFrame:
    return t.hold.groupBy("as_of").agg(F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("JN14_class_lookup", "SELECT asset_class, count(*) AS n, avg(ret) AS m FROM panel JOIN cls USING (asset) GROUP BY 1", "m", "n")
def _(t: Tables) -> DataFrame:
    return t.panel.join(t.cls, "asset").groupBy("asset_class").agg(F.count("*").alias("n"), F.avg("ret").alias("m"))


@query("JN15_pair_join", "SELECT a.asset AS asset_i, b.asset AS asset_j, sum(a.ret * b.ret) AS xy FROM panel a JOIN panel b ON a.date = b.date GROUP BY 1, 2", "xy")
def _(t: Tables) -> DataFrame:
    whole = t.panel.select(F.lit(0).alias("as_of"), F.unix_date("date").alias("k"), "asset", "ret")
    return gram.mirrored(gram.cells(whole)).select("asset_i", "asset_j", "xy")


@query("AGG12_group_exposure", _INV + " FINAL SELECT as_of, asset_class, sum(weight) AS exposure FROM iv JOIN cls ON cls.asset = iv.asset GROUP BY 1, 2", "exposure")
def _(t: Tables) -> DataFrame:
    return portfolio.exposure(_inverse(t), t.cls, ["as_of"], "asset_class")


@query("AGG17_pearson", _CORR + " FINAL SELECT asset_i, asset_j, avg(rho) AS rho FROM dist GROUP BY 1, 2", "rho")
def _(t: Tables) -> DataFrame:
    return estimators.correlation(t.win, W).groupBy("asset_i", "asset_j").agg(F.avg("rho").alias("rho"))


@query("AGG21_weighted_moments", f", q AS (SELECT *, pow({2.0 ** (-1 / MEAN_HALF_LIFE)!r}, 51 - k) AS w FROM win) FINAL SELECT as_of, asset, sum(w * ret) / sum(w) AS mean, sum(w * ret * ret) / sum(w) - (sum(w * ret) / sum(w)) ** 2 AS var FROM q GROUP BY 1, 2", "mean var", digits=10)
def _(t: Tables) -> DataFrame:
    w, r = decayed(F.col("k"), W - 1, MEAN_HALF_LIFE), F.col("ret")
    s = lambda e: F.sum(w * e) / F.sum(w)
    return t.win.groupBy("as_of", "asset").agg(s(r).alias("mean"), (s(r * r) - s(r) * s(r)).alias("var"))


@query("WIN04_running_frames", "SELECT asset, date, exp(sum(ln(1 + ret)) OVER w) AS wealth, max(ret) OVER w AS top, sum(ret) OVER w AS total, avg(ret) OVER w AS mean FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "wealth top total mean")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("ret")
    return t.panel.select("asset", "date", F.product(1 + r).over(w).alias("wealth"), F.max(r).over(w).alias("top"), F.sum(r).over(w).alias("total"), F.avg(r).over(w).alias("mean"))


@query("WIN09_last_rows", f"SELECT asset, date, ret FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS r FROM panel) WHERE r <= {VOL}", "ret")
def _(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))
    return t.panel.withColumn("r", r).where(F.col("r") <= VOL).select("asset", "date", "ret")


@query("ORD04_top_k", "SELECT as_of, asset, m FROM (SELECT as_of, asset, avg(ret) AS m, row_number() OVER (PARTITION BY as_of ORDER BY round(avg(ret), 10) DESC, asset) AS r FROM win GROUP BY 1, 2) WHERE r <= 3", "m")
def _(t: Tables) -> DataFrame:
    m = t.win.groupBy("as_of", "asset").agg(F.avg("ret").alias("m"))
    return m.withColumn("r", F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc(F.round("m", 10)), "asset"))).where("r <= 3").drop("r")  # the top k are the feature


@query("SET03_label_union", "SELECT asset FROM panel UNION SELECT asset_class FROM cls")
def _(t: Tables) -> DataFrame:
    return t.panel.select("asset").union(t.cls.select("asset_class")).distinct()


@query("FN03_strings_and_dates", "SELECT DISTINCT lower(asset) AS low, lpad(substr(asset, 2), 3, '0') AS padded, strftime(date_trunc('quarter', date), '%Y%m%d') AS quarter FROM panel")
def _(t: Tables) -> DataFrame:
    return t.panel.select(F.lower("asset").alias("low"), F.lpad(F.substring("asset", 2, 9), 3, "0").alias("padded"), F.date_format(F.date_trunc("quarter", "date"), "yyyyMMdd").alias("quarter")).distinct()


@query("FN07_null_handling", "SELECT asset, coalesce(avg(px), -1) AS mean, CASE WHEN count(px) > 0 THEN count(*) / count(px) END AS ratio FROM grid GROUP BY asset", "mean ratio", digits=5)
def _(t: Tables) -> DataFrame:
    from lodestrata.operators.cleaning import grid

    return grid(t.px).groupBy("asset").agg(F.coalesce(F.avg("px"), F.lit(-1.0)).alias("mean"), F.try_divide(F.count("*").cast("double"), F.count("px")).alias("ratio"))


@query("OPT09_risk_aversion", digits=5)
def _(t: Tables) -> DataFrame:
    return kernels.attainment(_scenarios(t, [1.1])).select("as_of", "model", "status", "gamma")


@query("OPT19_robust_return", _MEANS + _INV + ", se AS (SELECT as_of, asset, stddev_samp(ret) * sqrt(52) AS se FROM win GROUP BY 1, 2) FINAL SELECT iv.as_of, sum(mu * weight) AS nominal, sum(mu * weight) - 2.0 * sum(abs(se * weight)) AS box FROM iv JOIN mean ON mean.as_of = iv.as_of AND mean.asset = iv.asset AND method = 'sample' JOIN se ON se.as_of = iv.as_of AND se.asset = iv.asset GROUP BY 1", "nominal box")
def _(t: Tables) -> DataFrame:
    se = t.win.groupBy("as_of", "asset").agg((F.stddev_samp("ret") * F.sqrt(F.lit(52.0))).alias("se"))
    j = _inverse(t).join(_means(t).where("method = 'sample'"), ["as_of", "asset"]).join(se, ["as_of", "asset"])
    return j.groupBy("as_of").agg(F.sum(F.col("mu") * F.col("weight")).alias("nominal"), portfolio.box_return(F.col("mu"), F.col("weight"), F.col("se"), 2.0).alias("box"))


@query("BT12_scenario_metrics", _BOOKS + _PATHS + _METRICS + " FINAL SELECT * FROM met WHERE cost_bps IN (0, 25)", _MET_DOUBLES, "days")
def _(t: Tables) -> DataFrame:
    return backtest.metrics(_paths(t, [0.0, 25.0]), PER_YEAR)


@query("BT13_initial_and_recurring", _BOOKS + _GROW + """, ed AS (SELECT as_of, asset, arg_max(growth, date) AS g FROM gr GROUP BY 1, 2),
dr AS (SELECT strategy, s.next_as_of AS as_of, b.asset, weight * g / sum(weight * g) OVER (PARTITION BY strategy, b.as_of) AS drifted FROM book b JOIN ed ON ed.as_of = b.as_of AND ed.asset = b.asset JOIN sched s ON s.as_of = b.as_of WHERE s.next_as_of IS NOT NULL),
tv AS (SELECT b.strategy, b.as_of, sum(abs(b.weight - coalesce(dr.drifted, 0))) AS gross FROM book b LEFT JOIN dr ON dr.strategy = b.strategy AND dr.as_of = b.as_of AND dr.asset = b.asset GROUP BY 1, 2)
FINAL SELECT strategy, count(*) FILTER (as_of = (SELECT min(as_of) FROM sched)) AS initial, count(*) FILTER (as_of > (SELECT min(as_of) FROM sched)) AS recurring, avg(gross) FILTER (as_of > (SELECT min(as_of) FROM sched)) AS mean_recurring FROM tv GROUP BY 1""", "mean_recurring", "initial recurring")
def _(t: Tables) -> DataFrame:
    v, first = backtest.turnovers(_execs(t)), F.col("is_initial")
    return v.groupBy("strategy").agg(F.count(F.when(first, 1)).alias("initial"), F.count(F.when(~first, 1)).alias("recurring"), F.avg(F.when(~first, F.col("gross_turnover"))).alias("mean_recurring"))


@query("ROB07_clone_distortion", _INV + _EQ + ", f AS (SELECT as_of, CASE WHEN asset = 'L7' THEN 'L1' ELSE asset END AS asset, sum(weight) AS weight FROM iv GROUP BY 1, 2) FINAL SELECT coalesce(e.as_of, f.as_of) AS as_of, sum(abs(coalesce(f.weight, 0) - coalesce(e.weight, 0))) AS economic_l1 FROM (SELECT * FROM eq WHERE asset <> 'L7') e FULL JOIN f ON f.as_of = e.as_of AND f.asset = e.asset GROUP BY 1", "economic_l1")
def _(t: Tables) -> DataFrame:
    eq = portfolio.equal_weight(t.win.select("as_of", "asset").distinct()).where("asset != 'L7'")
    folded = portfolio.fold_clone(_inverse(t), "L7", "L1", ["as_of"])
    return portfolio.allocation_diagnostics(eq, folded, ["as_of"]).select("as_of", F.col("l1").alias("economic_l1"))


@query("ROB08_clone_experiment", digits=5)
def _(t: Tables) -> DataFrame:
    """Minimum variance with L1 cloned under two noise levels; distance after folding back."""
    noise = F.pmod(F.xxhash64("as_of", "k"), F.lit(2001)) / 1000.0 - 1.0
    levels = F.explode(F.array(F.lit(0.0), F.lit(0.05)))
    source = t.win.where("asset = 'L1'").withColumn("noise", levels)
    clone = source.withColumn("ret", F.col("ret") * (1 + F.col("noise") * noise)).withColumn("asset", F.lit("L1_CLONE"))
    out = []
    base = kernels.minimum_variance_weights(kernels.repaired(estimators.cov_sample(t.win, PER_YEAR, W)), CAP).select("as_of", "asset", "weight")
    for level in (0.0, 0.05):
        both = t.win.unionByName(clone.where(F.col("noise") == level).select(*t.win.columns))
        w = kernels.minimum_variance_weights(kernels.repaired(estimators.cov_sample(both, PER_YEAR)), CAP).select("as_of", "asset", "weight")
        raw = portfolio.allocation_diagnostics(base, w, ["as_of"]).select("as_of", F.col("l1").alias("raw_l1"))
        eco = portfolio.allocation_diagnostics(base, portfolio.fold_clone(w, "L1_CLONE", "L1", ["as_of"]), ["as_of"]).select("as_of", F.col("l1").alias("economic_l1"))
        out.append(raw.join(eco, "as_of").withColumn("noise", F.lit(level)))
    return out[0].unionByName(out[1])


@query("CLU04_cluster_experiment")
def _(t: Tables) -> DataFrame:
    """Clusters, medoid counts and the share of the universe per date and threshold."""
    return _clusters(t).groupBy("as_of", "threshold").agg(F.count_distinct("cluster").alias("medoids"), F.count("*").alias("assets")).withColumn("share", F.col("medoids") / F.col("assets"))


@query("CLU05_cluster_exposure_change")
def _(t: Tables) -> DataFrame:
    """Equal weights against inverse-volatility weights, by the clusters of 0.10."""
    panel = panels.complete_dates(t.wide)
    win = asof.training_windows(panel, asof.quarter_schedule(panel, W), W)
    eq = portfolio.equal_weight(win.select("as_of", "asset").distinct())
    iv = portfolio.inverse_volatility(win.groupBy("as_of", "asset").agg(F.stddev_samp("ret").alias("vol")), CAP)
    c = _clusters(t).where("threshold = 0.1").select("as_of", "asset", "cluster")
    both = eq.withColumnRenamed("weight", "a").join(iv.withColumnRenamed("weight", "b"), ["as_of", "asset"]).join(c, ["as_of", "asset"])
    return both.groupBy("as_of", "cluster").agg(F.sum(F.col("b") - F.col("a")).alias("d")).groupBy("as_of").agg(F.sum(F.abs("d")).alias("cluster_l1"))


@query("TAB01_overlapping_risk", _BOOKS + ", rk AS (SELECT strategy, h.as_of, stddev_samp(r) AS risk FROM (SELECT strategy, h.as_of, date, sum(weight * ret) AS r FROM book b JOIN hold h ON h.as_of = b.as_of AND h.asset = b.asset GROUP BY 1, 2, 3) h GROUP BY 1, 2 HAVING count(*) > 1), rr AS (SELECT strategy, min(risk) AS lo, max(risk) AS hi FROM rk GROUP BY 1) FINAL SELECT strategy, lo, hi, (SELECT max(lo) FROM rr) AS common_lo, (SELECT min(hi) FROM rr) AS common_hi FROM rr", "lo hi common_lo common_hi")
def _(t: Tables) -> DataFrame:
    r = _books(t).join(t.hold, ["as_of", "asset"]).groupBy("strategy", "as_of", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    risk = r.groupBy("strategy", "as_of").agg(F.stddev_samp("r").alias("risk"), F.count("*").alias("n")).where("n > 1")
    ranges = risk.groupBy("strategy").agg(F.min("risk").alias("lo"), F.max("risk").alias("hi"))
    common = ranges.agg(F.max("lo").alias("common_lo"), F.min("hi").alias("common_hi"))
    return ranges.join(F.broadcast(common))  # common is one row


@query("TAB03_robustness_table", digits=5)
def _(t: Tables) -> DataFrame:
    w = kernels.robust_weights(_scenarios(t, [1.05, 1.2]))
    one = w.groupBy("as_of", "model", "scenario").agg(F.first("status").alias("status"), F.first("message").alias("message"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"))
    return one.groupBy("model").agg(F.count("*").alias("solves"), F.avg((F.col("status") != "OPTIMAL").cast("double")).alias("failure_rate"), F.avg(F.when(F.col("message") == "binding", 1 / F.col("hhi"))).alias("effective_binding"))


# Policies


def momentum(window: dict[str, list[float]]) -> dict[str, float]:
    """In proportion to mean returns above zero; equal where there are none."""
    mean = {a: max(sum(r) / len(r), 0.0) for a, r in window.items()}
    total = sum(mean.values())
    return {a: m / total if total > 0 else 1 / len(mean) for a, m in mean.items()}


def levered(window: dict[str, list[float]]) -> dict[str, float]:
    """Momentum with half as much again where the first asset lost on average."""
    scale = 1.5 if sum(window["L1"]) < 0 else 1.0
    return {a: scale * w for a, w in momentum(window).items()}


def stranger(window: dict[str, list[float]]) -> dict[str, float]:
    """Half in an asset nobody knows, half sold short of the first where it gained."""
    if sum(window["L1"]) >= 0:
        return {"X9": 0.5, "L1": -0.5, "L2": 1.0}
    raise KeyError("X9")


POLICIES = {"momentum": momentum, "levered": levered, "stranger": stranger}

_MOMENTUM = """, mo AS (SELECT as_of, asset, greatest(avg(ret), 0) AS m, sum(ret) AS s FROM win GROUP BY 1, 2),
mw AS (SELECT as_of, asset, CASE WHEN sum(m) OVER (PARTITION BY as_of) > 0 THEN m / sum(m) OVER (PARTITION BY as_of) ELSE 1.0 / count(*) OVER (PARTITION BY as_of) END AS weight FROM mo),
fi AS (SELECT as_of, s < 0 AS lost FROM mo WHERE asset = 'L1')"""
_POLICIES = _MOMENTUM + """, pd AS (
  SELECT 'momentum' AS strategy, as_of, asset, weight, NULL AS fault FROM mw
  UNION ALL SELECT 'levered', mw.as_of, asset, weight, NULL FROM mw JOIN fi ON fi.as_of = mw.as_of WHERE NOT lost
  UNION ALL SELECT 'levered', mw.as_of, asset, NULL, 'ABOVE_CAP' FROM mw JOIN fi ON fi.as_of = mw.as_of WHERE lost AND 1.5 * weight > 1 + 5e-7
  UNION ALL SELECT 'levered', as_of, NULL, NULL, 'SUM' FROM fi WHERE lost
  UNION ALL SELECT 'stranger', as_of, a, NULL, f FROM fi, (VALUES ('L1', 'SHORT'), ('X9', 'UNKNOWN_ASSET')) x(a, f) WHERE NOT lost
  UNION ALL SELECT 'stranger', as_of, NULL, NULL, 'RAISED KeyError' FROM fi WHERE lost)"""


def _decisions(t: Tables) -> DataFrame:
    return t.once(policies.decisions(t.win, POLICIES))


@query("UDF01_policy_functions", _POLICIES + " FINAL SELECT * FROM pd", "weight")
def _(t: Tables) -> DataFrame:
    """Three policies as table functions: weights where they keep the rules, faults by date
    where they do not."""
    return policies.decisions(t.win, POLICIES)


@query("UDF01_policy_callback", _MOMENTUM + ", book AS (SELECT 'momentum' AS strategy, as_of, asset, weight FROM mw)" + _PATHS + _METRICS + " FINAL SELECT * FROM met WHERE cost_bps = 5", _MET_DOUBLES, "days")
def _(t: Tables) -> DataFrame:
    """A user's policy simulated: a function from a decision's window to weights."""
    weights = t.once(policies.decisions(t.win, {"momentum": momentum}).select("strategy", "as_of", "asset", "weight"))
    costs = t.spark.createDataFrame([(5.0,)], "cost_bps double")
    return backtest.metrics(backtest.wealth(weights, t.panel, t.sched, costs), PER_YEAR)


@query("OPT20_stored_registry", _BOOKS + _POLICIES + """, al AS (SELECT strategy, as_of, weight, NULL AS fault FROM book UNION ALL SELECT strategy, as_of, weight, fault FROM pd)
FINAL SELECT strategy, count(DISTINCT as_of) FILTER (weight IS NOT NULL) AS decisions, min(as_of) FILTER (weight IS NOT NULL) AS first, max(as_of) FILTER (weight IS NOT NULL) AS last, count(DISTINCT as_of) FILTER (fault IS NOT NULL) AS failures,
  CASE WHEN count(DISTINCT as_of) FILTER (weight IS NOT NULL) = (SELECT count(*) FROM sched) AND count(*) FILTER (fault IS NOT NULL) = 0 THEN 'COMPLETE' ELSE 'FAILED_EXPLICITLY' END AS status FROM al GROUP BY 1""", ints="decisions failures")
def _(t: Tables) -> DataFrame:
    """The strategies of a run as its stored books and failures have them, books by rule and
    policies."""
    made = _decisions(t)
    books = _books(t).select("strategy", "as_of", "asset", "weight").unionByName(made.where("fault IS NULL").drop("fault"))
    folder = panels.work_dir(t.spark)
    books.repartition("strategy").write.partitionBy("strategy").parquet(f"{folder}/books")
    made.where("fault IS NOT NULL").select("strategy", "as_of", "fault").write.parquet(f"{folder}/failures")
    return policies.registry(t.spark.read.parquet(f"{folder}/books"), t.spark.read.parquet(f"{folder}/failures"), t.sched)
