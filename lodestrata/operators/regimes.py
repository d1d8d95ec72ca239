"""Market regimes from a proxy's trend and volatility, strictly before each decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.medians import expanding_median


def features(proxy: DataFrame, trend: int, vol: int, per_year: int) -> DataFrame:
    """date, trend (compounded over ``trend`` rows before), rolling_vol (last ``vol`` rows)."""
    order = Window.orderBy("date")  # one series: a row a date
    window = order.rowsBetween(-(vol - 1), 0)
    past = order.rowsBetween(-trend, -1)
    rolling = F.when(F.count("ret").over(window) == vol, F.stddev_samp("ret").over(window) * F.sqrt(F.lit(float(per_year))))
    return proxy.withColumns({"trend": F.when(F.count("ret").over(past) == trend, F.product(1 + F.col("ret")).over(past) - 1), "rolling_vol": rolling})


def classify(proxy: DataFrame, schedule: DataFrame, trend: int, vol: int, per_year: int) -> DataFrame:
    """as_of, trend, latest_vol, vol_threshold, regime. The threshold is the median of the
    rolling volatilities before as_of, the newest of them included."""
    past = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # one series: a row a date
    f = features(proxy, trend, vol, per_year).withColumn("latest_vol", F.last("rolling_vol", ignorenulls=True).over(past))
    thresholds = expanding_median(f.select("date", F.lit("proxy").alias("asset"), F.col("rolling_vol").alias("ret"))).select("date", F.col("med").alias("vol_threshold"))
    at = f.join(thresholds, "date").withColumnRenamed("date", "as_of").where("trend IS NOT NULL AND latest_vol IS NOT NULL")
    joined = schedule.select("as_of").join(at, "as_of")
    high = F.col("latest_vol") > F.col("vol_threshold")
    regime = F.when((F.col("trend") > 0) & ~high, "CALM_GROWTH").when((F.col("trend") > 0) & high, "VOLATILE_GROWTH").when(~high, "WEAK_MARKET").otherwise("STRESS")
    return joined.select("as_of", "trend", "latest_vol", "vol_threshold", regime.alias("regime"))


REGIMES = ["CALM_GROWTH", "VOLATILE_GROWTH", "WEAK_MARKET", "STRESS"]


def summary(paths: DataFrame, held: DataFrame, regimes: DataFrame, per_year: int, least: int) -> DataFrame:
    """Per strategy and regime: rows, return, volatility, Sharpe, warning; regimes without
    rows have their row too. held: date, as_of."""
    spark = paths.sparkSession
    rows = paths.join(held, "date").join(regimes.select("as_of", "regime"), "as_of")
    vol = F.stddev_samp("net_return") * F.sqrt(F.lit(float(per_year)))
    stats = rows.groupBy("strategy", "regime").agg(F.count("*").alias("rows"), (F.avg("net_return") * per_year).alias("mean_return"), vol.alias("volatility"), F.when(vol > 0, F.avg("net_return") * per_year / vol).alias("sharpe"))
    every = paths.select("strategy").distinct().crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in REGIMES], "regime string")))  # strategies x four regimes
    joined = every.join(stats, ["strategy", "regime"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return joined.withColumn("warning", F.when(F.col("rows") == 0, "NO_OBSERVATIONS").when(F.col("rows") < least, "FEW_OBSERVATIONS"))
