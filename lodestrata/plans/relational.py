"""Queries of scans, cleaning, joins, aggregates, windows, sorts and sets over the panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import stats
from lodestrata.operators import asof, cleaning, regimes, resampling
from lodestrata.plans.base import PER_YEAR, TREND, VOL, W, Tables, query
from lodestrata.sources import panels
from lodestrata.sources.hashing import content_hashes

# Scans and sinks


@query("SRC01_wide_csv_scan", "SELECT date, asset, ret FROM panel", "ret")
def _(t: Tables) -> DataFrame:
    path = panels.work_dir(t.spark)
    panels.write_wide_csv(t.panel, path)
    return panels.read_wide_csv(t.spark, path)


@query("SRC02_asset_list", "SELECT DISTINCT asset FROM panel")
def _(t: Tables) -> DataFrame:
    return t.panel.select("asset").distinct()


@query("SRC02_date_list", "SELECT DISTINCT date FROM panel")
def _(t: Tables) -> DataFrame:
    return t.panel.select("date").distinct()


@query("SRC03_asof_scan", "SELECT date, asset, ret FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS r FROM panel WHERE date < DATE '1999-01-01' AND asset IN ('L1', 'L2')) WHERE r <= 52", "ret")
def _(t: Tables) -> DataFrame:
    return asof.before(t.panel, "1999-01-01", ["L1", "L2"], 52)


@query("SRC04_point_lookup", "SELECT p.date, asset, ret FROM panel p WHERE p.date = (SELECT max(date) FROM panel)", "ret")
def _(t: Tables) -> DataFrame:
    last = t.panel.agg(F.max("date").alias("date"))
    return t.panel.join(F.broadcast(last), "date")  # last is one row


@query("SRC05_trailing", "SELECT as_of, date, asset, ret FROM win WHERE k >= 39", "ret")
def _(t: Tables) -> DataFrame:
    return t.win.where("k >= 39").select("as_of", "date", "asset", "ret")


@query("SRC06_schedule_csv_scan", "SELECT as_of AS rebalance_date FROM sched")
def _(t: Tables) -> DataFrame:
    path = panels.work_dir(t.spark)
    t.sched.select(F.col("as_of").alias("rebalance_date")).write.csv(path, header=True)
    return t.spark.read.schema("rebalance_date date").csv(path, header=True)


@query("SRC07_metadata_kept", "SELECT g.asset, 'C' || (CAST(substr(g.asset, 2) AS INTEGER) % 3) AS asset_class FROM grid g GROUP BY g.asset HAVING avg(CASE WHEN px IS NULL THEN 1.0 ELSE 0.0 END) <= 0.10")
def _(t: Tables) -> DataFrame:
    return cleaning.metadata(t.px, panels.asset_classes(t.px)).where("kept").select("asset", "asset_class")


@query("SRC08_price_scan", "SELECT date, asset, px FROM px", "px", digits=6)
def _(t: Tables) -> DataFrame:
    path = panels.work_dir(t.spark)
    panels.write_wide_csv(t.px, path, "px")
    return panels.read_wide_csv(t.spark, path, "px")


@query("SRC10_price_field", "SELECT date, asset, coalesce(adj, px) AS px FROM (SELECT *, CASE WHEN asset <> 'L7' THEN px * 0.5 END AS adj FROM px)", "px", digits=6)
def _(t: Tables) -> DataFrame:
    two = t.px.withColumn("adj", F.when(F.col("asset") != "L7", F.col("px") * 0.5))
    return two.select("date", "asset", F.coalesce("adj", "px").alias("px"))


@query("SRC11_universe", "SELECT asset, min(asset_class) AS asset_class FROM (SELECT * FROM cls UNION ALL SELECT * FROM cls) GROUP BY asset")
def _(t: Tables) -> DataFrame:
    return t.cls.unionByName(t.cls).dropDuplicates(["asset"])


@query("SRC13_artifact_rescan", "SELECT as_of, asset, count(*) AS n FROM win GROUP BY 1, 2", ints="n")
def _(t: Tables) -> DataFrame:
    path = panels.work_dir(t.spark)
    t.win.write.parquet(path)
    return t.spark.read.parquet(path).groupBy("as_of", "asset").agg(F.count("*").alias("n"))


@query("SNK01_csv_sink", "SELECT as_of, k, asset, ret FROM win", "ret", "k")
def _(t: Tables) -> DataFrame:
    path = panels.work_dir(t.spark)
    t.win.select("as_of", "k", "asset", "ret").write.csv(path, header=True)
    return t.spark.read.schema("as_of date, k long, asset string, ret double").csv(path, header=True)


@query("SNK03_json_sink", "SELECT asset, CASE WHEN asset = 'L1' THEN NULL ELSE n END AS n FROM (SELECT asset, CAST(count(*) AS DOUBLE) AS n FROM panel GROUP BY asset)", "n")
def _(t: Tables) -> DataFrame:
    one = t.panel.groupBy("asset").agg(F.count("*").cast("double").alias("n")).withColumn("n", F.when(F.col("asset") == "L1", F.lit(float("nan"))).otherwise(F.col("n")))
    return panels.to_json_rows(one).select(F.from_json("json", "asset string, n double").alias("j")).select("j.*")


@query("SNK08_content_hash")
def _(t: Tables) -> DataFrame:
    return content_hashes(t.spark, f"{t.dir}/lineitem.parquet").select("bytes", "sha256")


@query("SNK10_cumulative_loss_figure", "SELECT asset, date, sum(ret * ret) OVER (PARTITION BY asset ORDER BY date) AS loss FROM panel", "loss")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return t.panel.select("asset", "date", F.sum(F.col("ret") * F.col("ret")).over(w).alias("loss"))


@query("SNK11_drawdown_figure", ", w AS (SELECT asset, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY asset ORDER BY date)) AS wealth FROM panel) FINAL SELECT asset, date, wealth, wealth / max(wealth) OVER (PARTITION BY asset ORDER BY date) - 1 AS drawdown FROM w", "wealth drawdown")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return t.panel.select("asset", "date", F.product(1 + F.col("ret")).over(w).alias("wealth")).withColumn("drawdown", F.col("wealth") / F.max("wealth").over(w) - 1)


# Cleaning


@query("PRJ01_strictly_before", "SELECT date, asset, ret FROM panel WHERE date < DATE '1998-04-06'", "ret")
def _(t: Tables) -> DataFrame:
    return asof.before(t.panel, "1998-04-06")


@query("PRJ03_missing_fraction", "SELECT asset, avg(CASE WHEN px IS NULL THEN 1.0 ELSE 0.0 END) AS missing_fraction, min(CASE WHEN px IS NOT NULL THEN date END) AS first_valid_date, max(CASE WHEN px IS NOT NULL THEN date END) AS last_valid_date FROM grid GROUP BY asset", "missing_fraction")
def _(t: Tables) -> DataFrame:
    return cleaning.coverage(cleaning.grid(t.px))


@query("PRJ05_keep_covered", "SELECT asset, count(px) AS n FROM grid GROUP BY asset HAVING avg(CASE WHEN px IS NULL THEN 1.0 ELSE 0.0 END) <= 0.05", ints="n")
def _(t: Tables) -> DataFrame:
    return cleaning.keep_covered(cleaning.grid(t.px), 0.05).groupBy("asset").agg(F.count("px").alias("n"))


_FILLED = ", f AS (SELECT date, asset, last_value(px IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS px FROM grid)"


@query("PRJ06_forward_fill", _FILLED + " FINAL SELECT * FROM f", "px", digits=6)
def _(t: Tables) -> DataFrame:
    return cleaning.forward_fill(cleaning.grid(t.px)).select("date", "asset", "px")


@query("PRJ07_drop_incomplete", "SELECT date, asset, px FROM grid WHERE date IN (SELECT date FROM grid GROUP BY date HAVING count(px) = count(*))", "px", digits=6)
def _(t: Tables) -> DataFrame:
    return cleaning.drop_incomplete_dates(cleaning.grid(t.px)).select("date", "asset", "px")


_CLEAN = _FILLED.replace("FROM grid", "FROM grid WHERE asset IN (SELECT asset FROM grid GROUP BY asset HAVING avg(CASE WHEN px IS NULL THEN 1.0 ELSE 0.0 END) <= 0.10)") + ", c AS (SELECT * FROM f WHERE date IN (SELECT date FROM f GROUP BY date HAVING count(px) = count(*)))"


@query("PRJ08_clean_returns", _CLEAN + " FINAL SELECT * FROM (SELECT date, asset, px / lag(px) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM c) WHERE ret IS NOT NULL", "ret")
def _(t: Tables) -> DataFrame:
    return cleaning.clean(t.px)


@query("PRJ09_metadata", "SELECT c.asset, c.asset_class, true AS downloaded, m.mf AS missing_fraction, strftime(m.a, '%Y-%m-%d') AS first_valid_date, strftime(m.b, '%Y-%m-%d') AS last_valid_date, m.mf <= 0.10 AS kept, NOT (m.mf <= 0.10) AS dropped FROM cls c JOIN (SELECT asset, avg(CASE WHEN px IS NULL THEN 1.0 ELSE 0.0 END) AS mf, min(CASE WHEN px IS NOT NULL THEN date END) AS a, max(CASE WHEN px IS NOT NULL THEN date END) AS b FROM grid GROUP BY asset) m ON m.asset = c.asset", "missing_fraction")
def _(t: Tables) -> DataFrame:
    return cleaning.metadata(t.px, t.cls)


@query("PRJ10_quarter_schedule", "SELECT as_of, pos, next_as_of FROM sched", ints="pos")
def _(t: Tables) -> DataFrame:
    return t.sched


@query("PRJ11_evaluation_rows", "SELECT as_of, date, asset, ret FROM hold", "ret")
def _(t: Tables) -> DataFrame:
    return t.hold.select("as_of", "date", "asset", "ret")


_FOLDS = """, fold AS (
  SELECT s.as_of, s.next_as_of, f.fit_start, f.fit_end, f.fit_rows, v.val_start, v.val_end, v.val_rows
  FROM sched s
  JOIN (SELECT as_of, min(date) AS fit_start, max(date) AS fit_end, count(DISTINCT date) AS fit_rows FROM win GROUP BY 1) f ON f.as_of = s.as_of
  JOIN (SELECT s.as_of, min(c.date) AS val_start, max(c.date) AS val_end, count(*) AS val_rows FROM sched s JOIN cal c ON c.date > s.as_of AND c.date < s.next_as_of GROUP BY 1) v ON v.as_of = s.as_of)"""


@query("PRJ12_folds", _FOLDS + " FINAL SELECT * FROM fold", ints="fit_rows val_rows")
def _(t: Tables) -> DataFrame:
    return asof.folds(t.panel, t.sched, W)


@query("PRJ13_outer_schedule", _FOLDS + " FINAL SELECT * FROM (SELECT as_of, count(*) OVER (ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_folds, max(val_end) OVER (ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_end FROM fold) WHERE prior_folds >= 4", ints="prior_folds")
def _(t: Tables) -> DataFrame:
    return asof.outer_schedule(asof.folds(t.panel, t.sched, W), 4)


@query("PRJ14_truncated_schedule", "SELECT as_of FROM sched ORDER BY as_of LIMIT 5")
def _(t: Tables) -> DataFrame:
    return t.sched.select("as_of").orderBy("as_of").limit(5)  # the first k dates are the feature


@query("PRJ15_strategy_names", "SELECT n, split_part(n, '_risk_', 1) AS model, CAST(replace(split_part(n, '_risk_', 2), 'pct', '') AS DOUBLE) / 100 AS target FROM (SELECT CASE WHEN asset < 'L4' THEN 'box' ELSE 'nominal' END || '_risk_' || lpad(CAST(CAST(substr(asset, 2) AS INTEGER) * 2 AS VARCHAR), 2, '0') || 'pct' AS n FROM cls)", "target")
def _(t: Tables) -> DataFrame:
    number = F.lpad((F.substring("asset", 2, 9).cast("int") * 2).cast("string"), 2, "0")
    named = t.cls.select(F.concat(F.when(F.col("asset") < "L4", "box").otherwise("nominal"), F.lit("_risk_"), number, F.lit("pct")).alias("n"))
    parts = F.split("n", "_risk_")
    return named.where(F.contains("n", F.lit("_risk_"))).select("n", parts[0].alias("model"), (F.replace(parts[1], F.lit("pct"), F.lit("")).cast("double") / 100).alias("target"))


@query("PRJ19_finite_guard", "SELECT asset, count(*) AS bad FROM raw_panel WHERE ret IS NULL OR isnan(ret) OR isinf(ret) GROUP BY asset", ints="bad")
def _(t: Tables) -> DataFrame:
    return t.raw.where(stats.null_if_not_finite(F.col("ret")).isNull()).groupBy("asset").agg(F.count("*").alias("bad"))


@query("PRJ21_history_rule", "SELECT s.as_of, a.asset, coalesce(count(w.ret), 0) AS observed, coalesce(count(w.ret), 0) >= 52 AS eligible, CASE WHEN coalesce(count(w.ret), 0) < 52 THEN 'INSUFFICIENT_HISTORY' END AS reason FROM sched s CROSS JOIN (SELECT asset FROM cls UNION ALL SELECT 'X9') a LEFT JOIN win w ON w.as_of = s.as_of AND w.asset = a.asset GROUP BY 1, 2", ints="observed")
def _(t: Tables) -> DataFrame:
    declared = t.cls.select("asset").unionByName(t.spark.range(1).select(F.lit("X9").alias("asset")))
    return asof.survivor_snapshot(t.win, declared, W)


_LISTING = ", li AS (SELECT asset, CASE WHEN asset = 'L2' THEN DATE '1998-07-01' ELSE DATE '1990-01-01' END AS listing_date, CASE WHEN asset = 'L3' THEN DATE '1999-10-01' END AS inactive_date FROM cls UNION ALL SELECT 'X9', DATE '1990-01-01', NULL)"


@query("PRJ23_point_in_time_snapshot", _LISTING + """, o AS (
  SELECT s.as_of, li.asset, li.listing_date, li.inactive_date, count(p.ret) AS observed
  FROM sched s CROSS JOIN li LEFT JOIN panel p ON p.asset = li.asset AND p.date < s.as_of GROUP BY 1, 2, 3, 4),
q AS (SELECT as_of, asset, observed, CASE WHEN listing_date >= as_of THEN 'NOT_LISTED' WHEN inactive_date <= as_of THEN 'INACTIVE' WHEN observed = 0 THEN 'NO_HISTORY' WHEN observed < 104 THEN 'INSUFFICIENT_HISTORY' END AS reason FROM o)
FINAL SELECT as_of, asset, observed, reason IS NULL AS eligible, reason FROM q""", ints="observed")
def _(t: Tables) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    li = t.cls.select("asset", F.when(F.col("asset") == "L2", day("1998-07-01")).otherwise(day("1990-01-01")).alias("listing_date"), F.when(F.col("asset") == "L3", day("1999-10-01")).alias("inactive_date"))
    li = li.unionByName(t.spark.range(1).select(F.lit("X9").alias("asset"), day("1990-01-01").alias("listing_date"), F.lit(None).cast("date").alias("inactive_date")))
    return asof.point_in_time_snapshot(t.panel, li, t.sched, 104)


# Joins beyond those inside other operators


@query("JN02_full_outer_align", "SELECT coalesce(a.asset, b.asset) AS asset, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM (SELECT asset, count(*) AS n FROM panel WHERE asset < 'L5' GROUP BY 1) a FULL JOIN (SELECT asset, count(*) AS n FROM panel WHERE asset > 'L2' GROUP BY 1) b ON a.asset = b.asset", ints="a b")
def _(t: Tables) -> DataFrame:
    a = t.panel.where("asset < 'L5'").groupBy("asset").agg(F.count("*").alias("a"))
    b = t.panel.where("asset > 'L2'").groupBy("asset").agg(F.count("*").alias("b"))
    return a.join(b, "asset", "full").fillna(0, ["a", "b"])


@query("JN07_missing_cells", "SELECT d.date, a.asset FROM (SELECT DISTINCT date FROM px) d CROSS JOIN (SELECT DISTINCT asset FROM px) a ANTI JOIN px ON px.date = d.date AND px.asset = a.asset")
def _(t: Tables) -> DataFrame:
    return cleaning.grid(t.px).select("date", "asset").join(t.px, ["date", "asset"], "left_anti")


@query("JN08_semi_join", "SELECT as_of, asset, avg(ret) AS m FROM win WHERE asset IN (SELECT asset FROM cls WHERE asset_class = 'C1') GROUP BY 1, 2", "m")
def _(t: Tables) -> DataFrame:
    return t.win.join(t.cls.where("asset_class = 'C1'"), "asset", "left_semi").groupBy("as_of", "asset").agg(F.avg("ret").alias("m"))


@query("JN09_anti_check", "SELECT DISTINCT date FROM raw_panel WHERE date NOT IN (SELECT date FROM sched s JOIN cal ON cal.date = s.as_of)")
def _(t: Tables) -> DataFrame:
    return t.raw.select("date").distinct().join(t.sched.select(F.col("as_of").alias("date")), "date", "left_anti")


@query("JN10_asof_join", "SELECT as_of, k, date, asset, ret FROM win", "ret", "k")
def _(t: Tables) -> DataFrame:
    return t.win


@query("JN13_joint_series", "SELECT a.date, a.ret AS l1, b.ret AS l2 FROM panel a JOIN panel b ON a.date = b.date AND a.asset = 'L1' AND b.asset = 'L2'", "l1 l2")
def _(t: Tables) -> DataFrame:
    p = t.panel.groupBy("date").pivot("asset", ["L1", "L2"]).agg(F.first("ret"))
    return p.where("L1 IS NOT NULL AND L2 IS NOT NULL").select("date", F.col("L1").alias("l1"), F.col("L2").alias("l2"))


_SEEDS = "SELECT as_of, CAST(strftime(as_of, '%Y%m%d') AS BIGINT) AS seed FROM sched"


@query("JN16_resample_join", resampling.block_sql(_SEEDS, "as_of", W, 4, 20) + " FINAL SELECT ix.as_of, draw, asset, avg(ret) AS m FROM ix JOIN win ON win.as_of = ix.as_of AND win.k = ix.source GROUP BY 1, 2, 3", "m", "draw")
def _(t: Tables) -> DataFrame:
    """Every decision's window, drawn again: rows by index."""
    seeds = t.sched.select("as_of", F.date_format("as_of", "yyyyMMdd").cast("int").alias("seed"))
    ix = resampling.block_draws(seeds, W, 4, 20).withColumnRenamed("source", "k")
    return ix.join(t.win, ["as_of", "k"]).groupBy("as_of", "draw", "asset").agg(F.avg("ret").alias("m"))


# Aggregates


@query("AGG01_moments", "SELECT asset, avg(ret) AS mean, stddev_samp(ret) AS sd, min(ret) AS lo, max(ret) AS hi, median(ret) AS med, sum(abs(ret)) AS l1, sum(ret * ret) AS ss, count(*) AS n, count(DISTINCT date) AS dates FROM panel GROUP BY asset", "mean sd lo hi med l1 ss", "n dates")
def _(t: Tables) -> DataFrame:
    r = F.col("ret")
    return t.panel.groupBy("asset").agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.min(r).alias("lo"), F.max(r).alias("hi"), F.median(r).alias("med"), F.sum(F.abs(r)).alias("l1"), F.sum(r * r).alias("ss"), F.count("*").alias("n"), F.count_distinct("date").alias("dates"))


@query("AGG05_interpolated_quantile", "SELECT asset, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.5) AS q50, quantile_cont(ret, 0.95) AS q95 FROM panel GROUP BY asset", "q05 q50 q95")
def _(t: Tables) -> DataFrame:
    return t.panel.groupBy("asset").agg(*[F.percentile("ret", F.lit(p)).alias(n) for p, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))])


@query("AGG06_compounded_growth", "SELECT as_of, asset, product(1 + ret) AS growth, pow(product(1 + ret), 52.0 / count(*)) - 1 AS cagr FROM win GROUP BY 1, 2", "growth cagr")
def _(t: Tables) -> DataFrame:
    return t.win.groupBy("as_of", "asset").agg(stats.growth("ret").alias("growth"), stats.cagr("ret", PER_YEAR).alias("cagr"))


@query("AGG09_rmse_bias", ", e AS (SELECT h.as_of, h.asset, avg(h.ret) - w.m AS e FROM hold h JOIN (SELECT as_of, asset, avg(ret) AS m FROM win GROUP BY 1, 2) w ON w.as_of = h.as_of AND w.asset = h.asset GROUP BY h.as_of, h.asset, w.m) FINAL SELECT asset, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM e GROUP BY asset", "rmse bias")
def _(t: Tables) -> DataFrame:
    m = t.win.groupBy("as_of", "asset").agg(F.avg("ret").alias("m"))
    e = t.hold.groupBy("as_of", "asset").agg(F.avg("ret").alias("r")).join(m, ["as_of", "asset"]).withColumn("e", F.col("r") - F.col("m"))
    return e.groupBy("asset").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))


@query("AGG11_two_level", "SELECT as_of, max(m) AS top FROM (SELECT as_of, asset_class, avg(ret) AS m FROM win JOIN cls USING (asset) GROUP BY 1, 2) GROUP BY 1", "top")
def _(t: Tables) -> DataFrame:
    return t.win.join(t.cls, "asset").groupBy("as_of", "asset_class").agg(F.avg("ret").alias("m")).groupBy("as_of").agg(F.max("m").alias("top"))


@query("AGG14_pivot", "SELECT as_of, avg(ret) FILTER (asset_class = 'C0') AS c0, avg(ret) FILTER (asset_class = 'C1') AS c1, avg(ret) FILTER (asset_class = 'C2') AS c2 FROM win JOIN cls USING (asset) GROUP BY 1", "c0 c1 c2")
def _(t: Tables) -> DataFrame:
    p = t.win.join(t.cls, "asset").groupBy("as_of").pivot("asset_class", ["C0", "C1", "C2"]).agg(F.avg("ret"))
    return p.select("as_of", *[F.col(c).alias(c.lower()) for c in ("C0", "C1", "C2")])


@query("AGG15_conditional_mean", "SELECT asset, avg(CASE WHEN ret > 0 THEN ret END) AS up, avg(CASE WHEN ret <> 0 THEN CAST(ret > 0 AS DOUBLE) END) AS share_up FROM panel GROUP BY asset", "up share_up")
def _(t: Tables) -> DataFrame:
    r = F.col("ret")
    return t.panel.groupBy("asset").agg(F.avg(F.when(r > 0, r)).alias("up"), F.avg(F.when(r != 0, (r > 0).cast("double"))).alias("share_up"))


@query("AGG18_unbiased_shape", "SELECT asset, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM panel GROUP BY asset", "skew kurt", digits=6)
def _(t: Tables) -> DataFrame:
    return t.panel.groupBy("asset").agg(stats.skewness_unbiased("ret").alias("skew"), stats.kurtosis_unbiased("ret").alias("kurt"))


@query("AGG20_cross_section", ", m AS (SELECT as_of, asset, avg(ret) * 52 AS mu FROM win GROUP BY 1, 2) FINAL SELECT as_of, avg(mu) AS mean, stddev_samp(mu) AS sd, min(mu) AS lo, max(mu) AS hi FROM m GROUP BY as_of", "mean sd lo hi")
def _(t: Tables) -> DataFrame:
    m = t.win.groupBy("as_of", "asset").agg((F.avg("ret") * PER_YEAR).alias("mu"))
    return m.groupBy("as_of").agg(F.avg("mu").alias("mean"), F.stddev_samp("mu").alias("sd"), F.min("mu").alias("lo"), F.max("mu").alias("hi"))


# Windows


@query("WIN01_rolling_sd", f"SELECT date, CASE WHEN count(*) OVER w = {VOL} THEN stddev_samp(ret) OVER w END AS sd FROM mkt WINDOW w AS (ORDER BY date ROWS BETWEEN {VOL - 1} PRECEDING AND CURRENT ROW)", "sd")
def _(t: Tables) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(-(VOL - 1), 0)  # one series: a row a date
    return t.mkt.select("date", F.when(F.count("*").over(w) == VOL, F.stddev_samp("ret").over(w)).alias("sd"))


@query("WIN02_trailing_growth", f"SELECT date, asset, CASE WHEN count(*) OVER w = {TREND} THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS growth FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {TREND} PRECEDING AND 1 PRECEDING)", "growth")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(-TREND, -1)
    return t.panel.select("date", "asset", F.when(F.count("*").over(w) == TREND, F.product(1 + F.col("ret")).over(w) - 1).alias("growth"))


@query("WIN03_expanding_median", "SELECT date, asset, quantile_cont(ret, 0.5) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM panel", "med")
def _(t: Tables) -> DataFrame:
    return regimes.expanding_median(t.panel)


@query("WIN07_lag_lead", "SELECT date, asset, lag(ret) OVER w AS before, lead(ret) OVER w AS after, row_number() OVER w - 1 AS pos FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date)", "before after", "pos")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("date")
    return t.panel.select("date", "asset", F.lag("ret").over(w).alias("before"), F.lead("ret").over(w).alias("after"), (F.row_number().over(w) - 1).alias("pos"))


# Sorts and sets


@query("ORD05_argmin_tie", "SELECT as_of, asset FROM (SELECT as_of, asset, row_number() OVER (PARTITION BY as_of ORDER BY round(avg(ret * ret), 10), asset) AS r FROM win GROUP BY 1, 2) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    m = t.win.groupBy("as_of", "asset").agg(F.round(F.avg(F.col("ret") * F.col("ret")), 10).alias("v"))
    return m.groupBy("as_of").agg(F.min(F.struct("v", "asset")).alias("s")).select("as_of", "s.asset")


@query("ORD03_custom_order", "SELECT asset, list_position(['L3', 'L1', 'L2'], asset) AS place FROM cls WHERE asset IN ('L1', 'L2', 'L3') ORDER BY place", ints="place")
def _(t: Tables) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ("L3", "L1", "L2"))), F.col("asset"))
    return t.cls.select("asset", place.alias("place")).where("place > 0").orderBy("place")


@query("ORD08_last_value", "SELECT asset, arg_max(ret, date) AS last_ret FROM panel GROUP BY asset", "last_ret")
def _(t: Tables) -> DataFrame:
    return t.panel.groupBy("asset").agg(F.max_by("ret", "date").alias("last_ret"))


@query("SET01_union_by_name", "SELECT 'w' AS kind, as_of, asset, count(*) AS n FROM win GROUP BY 2, 3 UNION ALL SELECT 'h', as_of, NULL, count(*) FROM hold GROUP BY 2", ints="n")
def _(t: Tables) -> DataFrame:
    a = t.win.groupBy("as_of", "asset").agg(F.count("*").alias("n")).withColumn("kind", F.lit("w"))
    b = t.hold.groupBy("as_of").agg(F.count("*").alias("n")).withColumn("kind", F.lit("h"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SET04_difference", "SELECT date FROM raw_panel EXCEPT SELECT as_of FROM sched")
def _(t: Tables) -> DataFrame:
    return t.raw.select("date").subtract(t.sched.select(F.col("as_of").alias("date")))


@query("SET05_common_range", "SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT asset, min(ret) AS lo, max(ret) AS hi FROM panel GROUP BY asset)", "lo hi")
def _(t: Tables) -> DataFrame:
    return t.panel.groupBy("asset").agg(F.min("ret").alias("lo"), F.max("ret").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
