"""The rest of the inventory by its own names: aggregates, windows, sorts, estimators,
guards, artifacts, cost models and conventions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import stats
from lodestrata.operators import asof, backtest, cleaning, estimators, kernels, portfolio, resampling
from lodestrata.plans.base import CAP, PER_YEAR, VOL_HALF_LIFE, W, Tables, query
from lodestrata.plans.config import Experiment, manifest, validated
from lodestrata.plans.research import _BOOKS, _DRAWS, _EQ, _EXEC, _GROW, _INV, _MEANS, _PATHS, _SAMPLE, _SERIES, B_VOL, _books, _clusters, _execs, _inverse, _length, _means, _medoids, _paths, _scenarios, _SEEDS, _seeds, _series, draws, draws_sql
from lodestrata.plans.rules import MULTIPLES, _covariances
from lodestrata.sources import panels, publish


def _by_date(kind: str = "asset") -> Window:
    return Window.partitionBy(kind).orderBy("date")


def _running(kind: str = "asset") -> Window:
    return _by_date(kind).rowsBetween(Window.unboundedPreceding, 0)


def _held(t: Tables) -> DataFrame:
    return t.win.select("as_of", "asset").distinct()


# Configuration and artifacts


@query("SRC12_configured_schedule", "SELECT min(date) AS as_of, min(pos) AS pos FROM cal GROUP BY date_trunc('quarter', date) HAVING min(pos) >= 104", ints="pos")
def _(t: Tables) -> DataFrame:
    """The schedule under a loaded and validated configuration."""
    run = Experiment.load(json.dumps({"window": 104, "per_year": PER_YEAR, "max_weight": CAP}))
    return asof.quarter_schedule(t.panel, run.window).select("as_of", "pos")


@query("SRC14_validated_artifacts", "SELECT as_of, count(*) AS n, sum(ret) AS total FROM win GROUP BY 1", "total", "n")
def _(t: Tables) -> DataFrame:
    """Artifacts are read back only under the configuration that made them."""
    run = Experiment(window=W, per_year=PER_YEAR, max_weight=CAP, bootstrap_block=8)
    path = panels.work_dir(t.spark)
    t.win.write.parquet(path)
    known = validated(manifest(t.spark, run, [f"{path}/*.parquet"], {"win": t.win.count()}), run)
    found = t.spark.read.schema(t.win.schema).parquet(path)
    if found.count() != known["counts"]["win"]:
        raise ValueError("the artifacts are not whole")
    return found.groupBy("as_of").agg(F.count("*").alias("n"), F.sum("ret").alias("total"))


@query("SNK02_csv_tables", _BOOKS + " FINAL SELECT 'weights' AS name, count(*) AS n, sum(weight) AS total FROM book UNION ALL SELECT 'windows', count(*), sum(ret) FROM win UNION ALL SELECT 'prices', count(*), sum(px) FROM px", "total", "n", digits=5)
def _(t: Tables) -> DataFrame:
    """Several tables as CSV folders under one root, each read back with its schema."""
    root, out = panels.work_dir(t.spark), None
    for name, df, value in (("weights", _books(t), "weight"), ("windows", t.win, "ret"), ("prices", t.px, "px")):
        df.write.csv(f"{root}/{name}", header=True)
        back = t.spark.read.schema(df.schema).csv(f"{root}/{name}", header=True)
        one = back.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(value).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SNK06_published_outputs", _BOOKS + " FINAL SELECT name, n, n AS listed, total, TRUE AS whole, TRUE AS refused FROM (SELECT 'weights' AS name, count(*) AS n, sum(weight) AS total FROM book UNION ALL SELECT 'windows', count(*), sum(ret) FROM win UNION ALL SELECT 'prices', count(*), sum(px) FROM px)", "total", "n listed", digits=5)
def _(t: Tables) -> DataFrame:
    """A run's tables published in one step; a second run is refused, every file is as listed."""
    tables = {"weights": (_books(t), "weight"), "windows": (t.win, "ret"), "prices": (t.px, "px")}
    config, target = Experiment(window=W, per_year=PER_YEAR, max_weight=CAP, bootstrap_block=8).sha256(), panels.work_dir(t.spark)
    known = publish.publish(t.spark, {n: df for n, (df, _) in tables.items()}, target, config)
    try:
        publish.publish(t.spark, {"windows": t.win}, target, config)
        refused = False
    except publish.InUse:
        refused = True
    whole = publish.damaged(t.spark, target).isEmpty()
    parts = [publish.published(t.spark, target, n).agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.lit(known["counts"][n]).alias("listed"), F.sum(v).alias("total"), F.lit(whole).alias("whole"), F.lit(refused).alias("refused")) for n, (_, v) in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SNK04_index_matrix", _SERIES + _DRAWS + " FINAL SELECT draw, strategy, count(*) AS positions, sum(ret) AS total FROM ix JOIN ser ON ser.pos = ix.source GROUP BY 1, 2", "total", "draw positions")
def _(t: Tables) -> DataFrame:
    """The index matrix of a resampling as a compressed table, read back and applied."""
    series = _series(t)
    return _stored_draws(t, series, _length(series))


def _stored_draws(t: Tables, series: DataFrame, rows: int) -> DataFrame:
    path = panels.work_dir(t.spark)
    draws(t, rows).write.option("compression", "zstd").parquet(path)
    ix = t.spark.read.parquet(path)
    return ix.join(series, F.col("source") == F.col("pos")).groupBy("draw", "strategy").agg(F.count("*").alias("positions"), F.sum("ret").alias("total"))


@query("SNK05_backtest_artifacts", _BOOKS + _PATHS + " FINAL SELECT 'ledger' AS artifact, strategy, count(*) AS n, sum(net_wealth) AS total FROM path WHERE cost_bps = 5 GROUP BY 2 UNION ALL SELECT 'weights', strategy, count(*), sum(weight) FROM book GROUP BY 2 UNION ALL SELECT 'details', strategy, count(*), sum(abs(weight - drifted)) FROM ex GROUP BY 2", "total", "n", digits=6)
def _(t: Tables) -> DataFrame:
    """Ledger, target weights and rebalance details as Parquet, partitioned by strategy."""
    root, out = panels.work_dir(t.spark), None
    details = _execs(t).withColumn("trade", F.abs(F.col("weight") - F.col("drifted")))
    for name, df, value in (("ledger", backtest.ledger(_paths(t, [5.0]), t.sched), "end_nav"), ("weights", _books(t), "weight"), ("details", details, "trade")):
        df.repartition("strategy").write.partitionBy("strategy").parquet(f"{root}/{name}")
        back = t.spark.read.parquet(f"{root}/{name}")
        one = back.groupBy("strategy").agg(F.count("*").alias("n"), F.sum(value).alias("total")).withColumn("artifact", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("SNK07_run_manifest", "SELECT 'panel' AS name, count(*) AS n FROM panel UNION ALL SELECT 'sched', count(*) FROM sched UNION ALL SELECT 'win', count(*) FROM win", ints="n")
def _(t: Tables) -> DataFrame:
    """A run's manifest (configuration hash, input hashes, row counts), its counts as rows."""
    run = Experiment(window=W, per_year=PER_YEAR, max_weight=CAP, bootstrap_block=8)
    text = manifest(t.spark, run, [f"{t.dir}/lineitem.parquet"], {"panel": t.panel.count(), "sched": t.sched.count(), "win": t.win.count()})
    parsed = t.spark.range(1).select(F.from_json(F.lit(text), "counts map<string,long>").alias("m"))
    return parsed.select(F.explode("m.counts").alias("name", "n"))


# Cleaning and universes


@query("PRJ04_valid_range", "SELECT asset, min(date) AS first_valid_date, max(date) AS last_valid_date FROM px WHERE px IS NOT NULL GROUP BY asset")
def _(t: Tables) -> DataFrame:
    return cleaning.coverage(cleaning.grid(t.px)).select("asset", "first_valid_date", "last_valid_date")


@query("PRJ17_slack_and_binding", _INV + " FINAL SELECT as_of, asset, 0.2 - weight AS slack, abs(weight - 1.0 / 7) AS error, 0.2 - weight <= 1e-6 AS binding FROM iv", "slack error")
def _(t: Tables) -> DataFrame:
    w = F.col("weight")
    return _inverse(t).select("as_of", "asset", (CAP - w).alias("slack"), F.abs(w - 1.0 / 7).alias("error"), (CAP - w <= 1e-6).alias("binding"))


_SNAP = "SELECT s.as_of, a.asset, count(w.ret) AS observed, count(w.ret) >= 52 AS eligible FROM sched s CROSS JOIN (SELECT asset FROM cls UNION ALL SELECT 'X9') a LEFT JOIN win w ON w.as_of = s.as_of AND w.asset = a.asset GROUP BY 1, 2"


def _declared(t: Tables) -> DataFrame:
    return t.cls.select("asset").unionByName(t.spark.range(1).select(F.lit("X9").alias("asset")))


@query("PRJ22_survivor_snapshot", f", sn AS ({_SNAP}) FINAL SELECT as_of, count(*) FILTER (eligible) AS eligible, count(*) FILTER (NOT eligible) AS refused, string_agg(asset, ',' ORDER BY asset) FILTER (eligible) AS members FROM sn GROUP BY 1", ints="eligible refused")
def _(t: Tables) -> DataFrame:
    s, ok = asof.survivor_snapshot(t.win, _declared(t), W), F.col("eligible")
    return s.groupBy("as_of").agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("refused"), F.array_join(F.array_sort(F.collect_list(F.when(ok, F.col("asset")))), ",").alias("members"))


@query("PRJ24_metadata_validation", ", md AS (SELECT asset, asset_class FROM cls WHERE asset <> 'L6' UNION ALL SELECT asset, asset_class FROM cls WHERE asset = 'L2') FINAL SELECT p.asset, CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'REPEATED' END AS fault FROM (SELECT DISTINCT asset FROM panel) p LEFT JOIN (SELECT asset, count(*) AS n FROM md GROUP BY 1) m ON m.asset = p.asset WHERE n IS NULL OR n > 1")
def _(t: Tables) -> DataFrame:
    """Assets without metadata, or with more than one row of it."""
    declared = t.cls.where("asset != 'L6'").unionByName(t.cls.where("asset = 'L2'"))
    n = declared.groupBy("asset").agg(F.count("*").alias("n"))
    fault = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "REPEATED")
    return t.panel.select("asset").distinct().join(n, "asset", "left").select("asset", fault.alias("fault")).where("fault IS NOT NULL")


@query("UDF04_universe_builders", f", sn AS ({_SNAP}) FINAL SELECT 'survivor' AS mode, as_of, asset FROM sn WHERE eligible UNION ALL SELECT 'positive', as_of, asset FROM win GROUP BY 2, 3 HAVING avg(ret) > 0")
def _(t: Tables) -> DataFrame:
    """A universe is any function from windows and declared assets to a snapshot."""
    builders = {
        "survivor": lambda win, declared: asof.survivor_snapshot(win, declared, W).where("eligible"),
        "positive": lambda win, declared: win.join(declared, "asset", "left_semi").groupBy("as_of", "asset").agg(F.avg("ret").alias("m")).where("m > 0"),
    }
    parts = [build(t.win, _declared(t)).select(F.lit(mode).alias("mode"), "as_of", "asset") for mode, build in builders.items()]
    return parts[0].unionByName(parts[1])


# Aggregates


@query("AGG02_sample_sd", "SELECT asset, stddev_samp(ret) AS sd, stddev_samp(ret) * sqrt(52) AS annual FROM panel GROUP BY asset", "sd annual")
def _(t: Tables) -> DataFrame:
    return t.panel.groupBy("asset").agg(F.stddev_samp("ret").alias("sd"), stats.annual_vol("ret", PER_YEAR).alias("annual"))


@query("AGG03_min_max", "SELECT as_of, min(ret) AS low, max(ret) AS high, min(date) AS first_date, max(date) AS last_date FROM win GROUP BY as_of", "low high")
def _(t: Tables) -> DataFrame:
    return t.win.groupBy("as_of").agg(F.min("ret").alias("low"), F.max("ret").alias("high"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("AGG04_median", "SELECT as_of, asset, median(ret) AS med FROM win GROUP BY 1, 2", "med")
def _(t: Tables) -> DataFrame:
    return t.win.groupBy("as_of", "asset").agg(F.median("ret").alias("med"))


@query("AGG07_sums", _INV + " FINAL SELECT as_of, sum(weight) AS total, sum(abs(weight - 1.0 / 7)) AS l1, sum(weight * weight) AS hhi FROM iv GROUP BY 1", "total l1 hhi")
def _(t: Tables) -> DataFrame:
    w = F.col("weight")
    return _inverse(t).groupBy("as_of").agg(F.sum(w).alias("total"), F.sum(F.abs(w - 1.0 / 7)).alias("l1"), F.sum(w * w).alias("hhi"))


@query("AGG08_counts", "SELECT as_of, count(*) AS cells, count(DISTINCT date) AS dates, count(DISTINCT asset) AS assets, count(DISTINCT asset_class) AS classes FROM win JOIN cls USING (asset) GROUP BY 1", ints="cells dates assets classes")
def _(t: Tables) -> DataFrame:
    return t.win.join(t.cls, "asset").groupBy("as_of").agg(F.count("*").alias("cells"), *[F.count_distinct(c).alias(n) for c, n in (("date", "dates"), ("asset", "assets"), ("asset_class", "classes"))])


@query("AGG10_named_aggregates", "SELECT asset, avg(ret) AS mean, stddev_samp(ret) AS sd, median(ret) AS med, min(ret) AS low, max(ret) AS high, count(*) AS n FROM win GROUP BY asset", "mean sd med low high", "n")
def _(t: Tables) -> DataFrame:
    named = {"mean": F.avg, "sd": F.stddev_samp, "med": F.median, "low": F.min, "high": F.max, "n": F.count}
    return t.win.groupBy("asset").agg(*[f("ret").alias(n) for n, f in named.items()])


@query("AGG13_distinct", "SELECT DISTINCT date, asset, ret FROM win", "ret")
def _(t: Tables) -> DataFrame:
    return t.win.dropDuplicates(["date", "asset"]).select("date", "asset", "ret")


@query("AGG16_sample_covariance", "SELECT a.asset AS asset_i, b.asset AS asset_j, covar_samp(a.ret, b.ret) AS cov FROM panel a JOIN panel b ON a.date = b.date GROUP BY 1, 2", "cov", digits=10)
def _(t: Tables) -> DataFrame:
    whole = t.panel.select(F.lit(0).alias("as_of"), F.unix_date("date").alias("k"), "asset", "ret")
    return estimators.cov_sample(whole, 1).drop("as_of")


@query("AGG19_kurtosis", "SELECT as_of, asset, kurtosis(ret) + 3 AS kurt FROM win GROUP BY 1, 2", "kurt", digits=6)
def _(t: Tables) -> DataFrame:
    return t.win.groupBy("as_of", "asset").agg(stats.kurtosis_unbiased("ret").alias("kurt"))


# Windows and sorts


@query("WIN05_drawdown", ", w AS (SELECT asset, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY asset ORDER BY date)) AS wealth FROM panel), d AS (SELECT asset, wealth / max(wealth) OVER (PARTITION BY asset ORDER BY date) - 1 AS dd FROM w) FINAL SELECT asset, min(dd) AS max_drawdown, avg(dd) AS mean_drawdown FROM d GROUP BY asset", "max_drawdown mean_drawdown")
def _(t: Tables) -> DataFrame:
    w = t.panel.select("asset", "date", F.product(1 + F.col("ret")).over(_running()).alias("wealth"))
    return w.withColumn("dd", F.col("wealth") / F.max("wealth").over(_running()) - 1).groupBy("asset").agg(F.min("dd").alias("max_drawdown"), F.avg("dd").alias("mean_drawdown"))


@query("WIN06_cumulative_sum", "SELECT asset, date, sum(ret) OVER (PARTITION BY asset ORDER BY date) AS total FROM panel", "total")
def _(t: Tables) -> DataFrame:
    return t.panel.select("asset", "date", F.sum("ret").over(_running()).alias("total"))


@query("WIN08_next_decision", "SELECT as_of, next_as_of, date_diff('day', as_of, next_as_of) AS days FROM sched", ints="days")
def _(t: Tables) -> DataFrame:
    return t.sched.select("as_of", "next_as_of", F.date_diff("next_as_of", "as_of").alias("days"))


@query("WIN11_row_position", "SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS pos FROM panel", ints="pos")
def _(t: Tables) -> DataFrame:
    return t.panel.select("asset", "date", (F.row_number().over(_by_date()) - 1).alias("pos"))


@query("ORD01_sorted_panel", "SELECT date, asset, ret FROM raw_panel ORDER BY date, asset", "ret")
def _(t: Tables) -> DataFrame:
    return t.raw.select("date", "asset", "ret").orderBy("date", "asset")


@query("ORD02_multi_key_sort", _BOOKS + " FINAL SELECT as_of, strategy, asset, weight FROM book ORDER BY as_of, strategy, asset", "weight")
def _(t: Tables) -> DataFrame:
    return _books(t).select("as_of", "strategy", "asset", "weight").orderBy("as_of", "strategy", "asset")


@query("ORD06_arg_max", "SELECT as_of, asset, r AS high FROM (SELECT as_of, asset, round(max(ret), 10) AS r, row_number() OVER (PARTITION BY as_of ORDER BY round(max(ret), 10) DESC, asset) AS i FROM win GROUP BY 1, 2) WHERE i = 1", "high")
def _(t: Tables) -> DataFrame:
    """The asset with the largest weekly return of a window; of ties the first by name."""
    top = t.win.groupBy("as_of", "asset").agg(F.round(F.max("ret"), 10).alias("high"))
    best = top.groupBy("as_of").agg(F.min(F.struct((-F.col("high")).alias("low"), "asset")).alias("b"))
    return best.select("as_of", "b.asset", (-F.col("b.low")).alias("high"))


@query("ORD07_closest_candidate", ", v AS (SELECT as_of, asset, stddev_samp(ret) * sqrt(52) AS vol FROM win GROUP BY 1, 2), c AS (SELECT as_of, asset, vol, avg(vol) OVER (PARTITION BY as_of) AS target FROM v) FINAL SELECT as_of, asset, abs(vol - target) AS error FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY round(abs(vol - target), 12), asset) AS i FROM c) WHERE i = 1", "error")
def _(t: Tables) -> DataFrame:
    """Per date the asset whose volatility is nearest to the mean."""
    v = t.win.groupBy("as_of", "asset").agg(stats.annual_vol("ret", PER_YEAR).alias("vol"))
    e = v.withColumn("error", F.round(F.abs(F.col("vol") - F.avg("vol").over(Window.partitionBy("as_of"))), 12))
    return e.groupBy("as_of").agg(F.min(F.struct("error", "asset")).alias("b")).select("as_of", "b.asset", "b.error")


@query("SET02_union_of_segments", "SELECT date, asset, ret, row_number() OVER (PARTITION BY asset ORDER BY date) AS r FROM hold", "ret", "r")
def _(t: Tables) -> DataFrame:
    """Segments after each decision, split in two and put together again in time order."""
    odd = F.pmod(F.date_diff("as_of", F.lit("1970-01-01").cast("date")), F.lit(2)) == 1
    both = t.hold.where(odd).unionByName(t.hold.where(~odd))
    return both.select("date", "asset", "ret", F.row_number().over(_by_date()).alias("r"))


# Estimators


def _mean(method: str):
    @query(f"EST0{('ewma', 'shrink_zero', 'shrink_grand_mean').index(method) + 2}_mean_{method}", _MEANS + f" FINAL SELECT as_of, asset, mu FROM mean WHERE method = '{method}'", "mu")
    def _(t: Tables) -> DataFrame:
        return _means(t).where(F.col("method") == method).drop("method")


for _method in ("ewma", "shrink_zero", "shrink_grand_mean"):
    _mean(_method)


@query("EST08_iewma_diagonal_batch", resampling.block_sql(_SEEDS, "as_of", W, 8, 20) + f", dr AS (SELECT w.as_of, ix.draw, w.asset, ix.position AS k, w.ret FROM ix JOIN win w ON w.as_of = ix.as_of AND w.k = ix.source) FINAL SELECT as_of, draw, asset, 52 * pow({B_VOL!r}, 51) * sum(CASE WHEN k = 0 THEN greatest(ret * ret, 1e-14) ELSE {1 - B_VOL!r} * ret * ret / pow({B_VOL!r}, k) END) AS var FROM dr GROUP BY 1, 2, 3", "var", "draw", digits=10)
def _(t: Tables) -> DataFrame:
    """Last EW variances of 20 block-bootstrapped windows a date, each a weighted sum."""
    ix = resampling.block_draws(_seeds(t), W, 8, 20)
    drawn = ix.withColumnRenamed("source", "k").join(t.win.drop("date"), ["as_of", "k"]).select("as_of", "draw", "asset", F.col("position").alias("k"), "ret")
    return estimators.last_ew_variance(drawn, ["as_of", "draw", "asset"], W, VOL_HALF_LIFE).withColumn("var", PER_YEAR * F.col("var"))


@query("EST11_eigen_floor")
def _(t: Tables) -> DataFrame:
    """Covariances pushed off PSD, then lifted: the ridge and the least eigenvalue."""
    pushed = estimators.cov_sample(t.win, PER_YEAR, W).withColumn("cov", F.col("cov") - F.when(F.col("asset_i") == F.col("asset_j"), 1e-3).otherwise(0.0))
    lifted = kernels.repaired(pushed)
    return lifted.select("as_of", "ridge").join(kernels.diagnostics(lifted), "as_of").select("as_of", "ridge", "min_eigenvalue")


# Portfolios


@query("OPT05_capacity", "SELECT as_of, cap, n AS assets, n * cap >= 1 AS feasible FROM (SELECT as_of, count(DISTINCT asset) AS n FROM win GROUP BY 1), (VALUES (0.1), (0.2)) c(cap)", "cap", "assets")
def _(t: Tables) -> DataFrame:
    return portfolio.capacity(t.win, [0.1, 0.2])


@query("OPT11_clean_weights", _INV + ", q AS (SELECT as_of, asset, greatest(least(weight - 1e-7, 0.2), 0.0) AS weight FROM iv), g AS (SELECT *, 1 - sum(weight) OVER (PARTITION BY as_of) AS gap, row_number() OVER (PARTITION BY as_of ORDER BY round(0.2 - weight, 12) DESC, asset) AS r FROM q) FINAL SELECT as_of, asset, weight + CASE WHEN r = 1 THEN gap ELSE 0 END AS weight FROM g", "weight")
def _(t: Tables) -> DataFrame:
    off = _inverse(t).withColumn("weight", F.col("weight") - 1e-7)
    return portfolio.clean_weights(off, ["as_of"], CAP)


@query("OPT12_covariance_faults", _SAMPLE + " FINAL SELECT as_of, count(DISTINCT asset_i) AS assets, count(*) AS cells, 0 AS not_finite, 0.0 AS asymmetry, 0 AS beyond, TRUE AS valid FROM cov GROUP BY 1", "asymmetry", "assets cells not_finite beyond")
def _(t: Tables) -> DataFrame:
    return estimators.covariance_faults(estimators.cov_sample(t.win, PER_YEAR, W))


_SE = ", se AS (SELECT as_of, asset, stddev_samp(ret) * sqrt(52) AS se FROM win GROUP BY 1, 2)"


def _errors(t: Tables) -> DataFrame:
    return t.win.groupBy("as_of", "asset").agg(stats.annual_vol("ret", PER_YEAR).alias("se"))


@query("OPT16_inner_problems", _MEANS + _SAMPLE + _EQ + _SE + """, cw AS (SELECT c.as_of, c.asset_i AS asset, sum(cov * weight) AS cw FROM cov c JOIN eq ON eq.as_of = c.as_of AND eq.asset = c.asset_j GROUP BY 1, 2)
FINAL SELECT eq.as_of, eq.asset, weight, mu - 1.5 * se AS box_mu, mu - 1.5 * cw / sqrt(sum(weight * cw) OVER (PARTITION BY eq.as_of)) AS ellipsoid_mu FROM eq JOIN mean ON mean.as_of = eq.as_of AND mean.asset = eq.asset AND method = 'sample' JOIN se ON se.as_of = eq.as_of AND se.asset = eq.asset JOIN cw ON cw.as_of = eq.as_of AND cw.asset = eq.asset""", "weight box_mu ellipsoid_mu")
def _(t: Tables) -> DataFrame:
    """The means at which the box and the ellipsoid are worst for equal weights."""
    mu = _means(t).where("method = 'sample'").drop("method")
    return portfolio.worst_means(portfolio.equal_weight(_held(t)), mu, _errors(t), estimators.cov_sample(t.win, PER_YEAR, W), 1.5)


@query("OPT16_solved_inner_problems", _INV + _MEANS + _SAMPLE.replace(", cov AS", ", covs AS") + _SE + """, cw AS (SELECT c.as_of, sum(cov * a.weight * b.weight) AS risk, sum(CASE WHEN c.asset_i = c.asset_j THEN 1.3 ELSE 1 END * cov * a.weight * b.weight) AS shifted FROM covs c JOIN iv a ON a.as_of = c.as_of AND a.asset = c.asset_i JOIN iv b ON b.as_of = c.as_of AND b.asset = c.asset_j GROUP BY 1),
mw AS (SELECT iv.as_of, sum(mu * weight) AS m, sum(abs(se * weight)) AS box FROM iv JOIN mean ON mean.as_of = iv.as_of AND mean.asset = iv.asset AND method = 'sample' JOIN se ON se.as_of = iv.as_of AND se.asset = iv.asset GROUP BY 1),
cl AS (SELECT mw.as_of, 'box' AS model, m - 1.5 * box AS closed FROM mw UNION ALL SELECT as_of, 'diagonal', shifted FROM cw UNION ALL SELECT mw.as_of, 'ellipsoid', m - 1.5 * sqrt(risk) FROM mw JOIN cw ON cw.as_of = mw.as_of)
FINAL SELECT as_of, model, closed, closed AS solved FROM cl""", "closed solved")
def _(t: Tables) -> DataFrame:
    """Worst cases of inverse-volatility weights, by closed forms and by solving for them."""
    mu = _means(t).where("method = 'sample'").drop("method")
    return portfolio.solved_inner_problems(t.once(_inverse(t)), mu, _errors(t), estimators.cov_sample(t.win, PER_YEAR, W), 1.5, 0.3)


@query("OPT18_model_problems", "SELECT as_of, model, uses_box, uses_diagonal, uses_ellipsoid FROM sched, (VALUES ('nominal', FALSE, FALSE, FALSE), ('box', TRUE, FALSE, FALSE), ('box_diagonal', TRUE, TRUE, FALSE), ('ellipsoid', FALSE, FALSE, TRUE)) m(model, uses_box, uses_diagonal, uses_ellipsoid)")
def _(t: Tables) -> DataFrame:
    """Which uncertainty each model's problem takes in, per decision, from the stored inputs
    of the solver."""
    return kernels.model_terms(t.once(_scenarios(t, [1.2])))


@query("OPT20_strategy_registry", "SELECT strategy, count(*) AS decisions FROM sched, (SELECT model || '_risk_' || lpad(CAST(c AS VARCHAR), 2, '0') || 'pct' AS strategy FROM (VALUES ('nominal'), ('box'), ('box_diagonal'), ('ellipsoid')) m(model), (VALUES (6), (8), (10), (12), (14)) r(c) UNION ALL SELECT 'gmv_' || e FROM (VALUES ('sample'), ('ewma'), ('iewma'), ('ledoit_wolf')) g(e)) GROUP BY 1", ints="decisions")
def _(t: Tables) -> DataFrame:
    """The strategies a run has solved or failed to, named after their stored inputs: model and
    ceiling of a scenario, estimator of a covariance; with how many decisions of each."""
    ceilings = {m: f"{round(100 * c):02d}pct" for m, c in zip(MULTIPLES, Experiment().ceilings, strict=True)}
    level = reduce(lambda e, mc: F.when(F.col("multiple") == mc[0], mc[1]).otherwise(e), ceilings.items(), F.lit(None))
    scenarios = t.once(_scenarios(t, list(ceilings)).withColumn("scenario", level))
    solved = kernels.robust_weights(scenarios).select(F.concat_ws("_risk_", "model", "scenario").alias("strategy"), "as_of")
    stored = [kernels.minimum_variance_weights(kernels.repaired(c), CAP).select(F.lit(f"gmv_{m}").alias("strategy"), "as_of") for m, c in _covariances(t).items()]
    return t.once(reduce(DataFrame.unionByName, [solved, *stored])).groupBy("strategy").agg(F.count_distinct("as_of").alias("decisions"))


# Backtests, inference, robustness, tables


@query("UDF02_cost_models", _BOOKS + _GROW + _EXEC + " FINAL SELECT strategy, as_of, 0.0 AS none, sum(abs(weight - drifted)) * 0.001 AS linear, sum((weight - drifted) ** 2) * 0.5 AS impact FROM ex GROUP BY 1, 2", "none linear impact")
def _(t: Tables) -> DataFrame:
    """Costs of each decision's trades under three models, one of them the user's own."""
    own = backtest.CostModel("impact", lambda trade: 0.5 * trade * trade)
    trade = F.col("weight") - F.col("drifted")
    return _execs(t).groupBy("strategy", "as_of").agg(*[m.total(trade) for m in (backtest.no_cost(), backtest.linear_cost(10.0), own)])


@query("UDF03_execution_clock", "SELECT s.as_of, c.date AS information_as_of, s.as_of AS executed_at FROM sched s LEFT JOIN cal c ON c.pos = s.pos - 2")
def _(t: Tables) -> DataFrame:
    return backtest.Execution("delayed", lag=2).clock(asof.calendar(t.panel), t.sched)


_PAIRED = """, sr AS (SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS pos, net_return AS ret FROM path WHERE cost_bps = 5)""" + draws_sql("SELECT max(pos) + 1 AS n FROM sr") + """,
st AS (SELECT draw, strategy, avg(ret) * 52 AS mean, stddev_samp(ret) * sqrt(52) AS vol FROM ix JOIN sr ON sr.pos = ix.source GROUP BY 1, 2),
rp AS (SELECT draw, strategy, CASE WHEN vol > 0 THEN mean / vol END AS sharpe, mean - 1.5 * vol * vol AS ce FROM st),
df AS (SELECT b.strategy AS comparator, a.strategy, a.sharpe - b.sharpe AS sharpe, a.ce - b.ce AS ce FROM rp a JOIN rp b ON a.draw = b.draw AND b.strategy IN ('equal', 'class_equal') AND a.strategy <> b.strategy)"""


@query("INF06_inference_driver", _BOOKS + _PATHS + _PAIRED + " FINAL SELECT comparator, strategy, metric, quantile_cont(value, 0.025) AS ci_lower, quantile_cont(value, 0.975) AS ci_upper FROM (UNPIVOT df ON sharpe, ce INTO NAME metric VALUE value) GROUP BY 1, 2, 3", "ci_lower ci_upper", digits=6)
def _(t: Tables) -> DataFrame:
    """Paired intervals of the simulated strategies against two comparators."""
    series = _simulated(t)
    return _driven(t, series)


def _simulated(t: Tables) -> DataFrame:
    pos = F.row_number().over(_by_date("strategy")) - 1
    return t.once(_paths(t, [5.0]).select("strategy", pos.alias("pos"), F.col("net_return").alias("ret")))


def _driven(t: Tables, series: DataFrame) -> DataFrame:
    rep = t.once(resampling.replicate_statistics(series, draws(t, _length(series)), PER_YEAR, 3.0))
    parts = [resampling.paired_intervals(rep, c, 0.95).withColumn("comparator", F.lit(c)) for c in ("equal", "class_equal")]
    return parts[0].unionByName(parts[1])


@query("ROB04_mean_shocks", _MEANS + _SE + " FINAL SELECT CASE WHEN s > 0 THEN 'up' ELSE 'down' END AS shock, m.as_of, m.asset, mu + s * se AS mu FROM (SELECT * FROM mean WHERE method = 'sample') m JOIN se ON se.as_of = m.as_of AND se.asset = m.asset, (VALUES (1), (-1)) x(s)", "mu")
def _(t: Tables) -> DataFrame:
    j = _means(t).where("method = 'sample'").join(_errors(t), ["as_of", "asset"]).withColumn("s", F.explode(F.array(F.lit(1), F.lit(-1))))
    return j.select(F.when(F.col("s") > 0, "up").otherwise("down").alias("shock"), "as_of", "asset", (F.col("mu") + F.col("s") * F.col("se")).alias("mu"))


@query("TAB04_redundancy_table")
def _(t: Tables) -> DataFrame:
    """Equal weights over the whole universe and over the clusters' medoids: assets and risk."""
    full = _clusters(t).select("as_of", "threshold", "asset", F.lit("FULL").alias("universe"))
    one = _medoids(t).select("as_of", "threshold", F.col("medoid").alias("asset"), F.lit("MEDOID").alias("universe"))
    panel = t.once(panels.complete_dates(t.wide))
    hold = asof.holding_rows(panel, asof.quarter_schedule(panel, W))
    r = full.unionByName(one).join(hold, ["as_of", "asset"]).groupBy("universe", "threshold", "as_of", "date").agg(F.avg("ret").alias("r"), F.count("*").alias("assets"))
    return r.groupBy("universe", "threshold").agg(F.avg("assets").alias("assets"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("risk")).orderBy("threshold", "universe")


@query("TAB06_resimulation", _BOOKS + _PATHS + " FINAL SELECT strategy, cost_bps, date, net_wealth FROM path WHERE cost_bps IN (5, 10)", "cost_bps net_wealth")
def _(t: Tables) -> DataFrame:
    """Stored target weights read back and simulated again at two costs."""
    path = panels.work_dir(t.spark)
    _books(t).write.parquet(path)
    costs = t.spark.createDataFrame([(5.0,), (10.0,)], "cost_bps double")
    again = backtest.wealth(t.spark.read.parquet(path), t.panel, t.sched, costs, t.once)
    return again.select("strategy", "cost_bps", "date", "net_wealth")
