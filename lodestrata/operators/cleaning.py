"""From raw prices to returns: coverage, filling, returns, schedule, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MISSING_LIMIT, FILL_LIMIT = 0.10, 5


def grid(prices: DataFrame) -> DataFrame:
    """Every date with every asset; px is null where there was no row."""
    dates, assets = prices.select("date").distinct(), prices.select("asset").distinct()
    return dates.crossJoin(assets).join(prices, ["date", "asset"], "left")  # dates x assets is the panel's own size


def coverage(dense: DataFrame) -> DataFrame:
    """Per asset: missing_fraction, first_valid_date, last_valid_date."""
    have = F.when(F.col("px").isNotNull(), F.col("date"))
    return dense.groupBy("asset").agg(F.avg(F.isnull("px").cast("double")).alias("missing_fraction"), F.min(have).alias("first_valid_date"), F.max(have).alias("last_valid_date"))


def keep_covered(dense: DataFrame, limit: float = MISSING_LIMIT) -> DataFrame:
    kept = coverage(dense).where(F.col("missing_fraction") <= limit).select("asset")
    return dense.join(kept, "asset", "left_semi")


def forward_fill(dense: DataFrame, limit: int = FILL_LIMIT) -> DataFrame:
    """A gap takes the last price of at most ``limit`` rows before."""
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(-limit, 0)
    return dense.withColumn("px", F.last("px", ignorenulls=True).over(w))


def drop_incomplete_dates(dense: DataFrame) -> DataFrame:
    full = dense.groupBy("date").agg((F.count("px") == F.count("*")).alias("full")).where("full").select("date")
    return dense.join(full, "date", "left_semi")


def simple_returns(prices: DataFrame) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("date")
    return prices.withColumn("ret", F.col("px") / F.lag("px").over(w) - 1).where("ret IS NOT NULL").select("date", "asset", "ret")


def clean(prices: DataFrame, missing: float = MISSING_LIMIT, fill: int = FILL_LIMIT) -> DataFrame:
    """Prices to returns: drop thin assets, fill short gaps, drop incomplete dates."""
    return simple_returns(drop_incomplete_dates(forward_fill(keep_covered(grid(prices), missing), fill)))


def metadata(prices: DataFrame, classes: DataFrame, limit: float = MISSING_LIMIT) -> DataFrame:
    """One row a declared asset, with or without prices; dates as ISO text."""
    c = coverage(grid(prices))
    joined = classes.join(c, "asset", "left")
    iso = lambda x: F.date_format(x, "yyyy-MM-dd").alias(x)
    kept = F.coalesce(F.col("missing_fraction") <= limit, F.lit(False))
    return joined.select("asset", "asset_class", F.col("missing_fraction").isNotNull().alias("downloaded"), F.coalesce("missing_fraction", F.lit(1.0)).alias("missing_fraction"), iso("first_valid_date"), iso("last_valid_date"), kept.alias("kept"), (F.col("missing_fraction").isNotNull() & ~kept).alias("dropped"))
