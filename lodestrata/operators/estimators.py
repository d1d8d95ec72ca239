"""Means and covariances of training windows (as_of, k, asset, ret), as SQL plans.

Pairs of assets are cells of blocked products (``gram``) in one order, the other is their
mirror. Recursions are written as weighted running sums, so no order-dependent state crosses
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.stats import decayed, half_life_decay
from lodestrata.operators.gram import KEYS, cells, covariance, mirrored, pearson

#: Where scaled returns are clipped, the least variance.
CLIP, FLOOR = 4.2, 1e-14


def means(windows: DataFrame, window: int, per_year: int, half_life: float, shrink: float) -> DataFrame:
    """as_of, asset, method, mu for the four mean methods."""
    w = decayed(F.col("k"), window - 1, half_life)
    base = windows.groupBy("as_of", "asset").agg((F.avg("ret") * per_year).alias("sample"), (F.sum(w * F.col("ret")) / F.sum(w) * per_year).alias("ewma"))
    grand = F.avg("sample").over(Window.partitionBy("as_of"))
    full = base.withColumns({"shrink_zero": (1 - shrink) * F.col("sample"), "shrink_grand_mean": (1 - shrink) * F.col("sample") + shrink * grand})
    return full.unpivot(["as_of", "asset"], ["sample", "ewma", "shrink_zero", "shrink_grand_mean"], "method", "mu")


def cov_sample(windows: DataFrame, per_year: int, window: int | None = None) -> DataFrame:
    return mirrored(cells(windows, places=window).select(*KEYS, (covariance() * per_year).alias("cov")))


def cov_ewma(windows: DataFrame, window: int, per_year: int, half_life: float) -> DataFrame:
    """Normalised half-life weights, weighted means taken off, no bias correction."""
    s = lambda c: F.col(c) / F.col("w")
    met = cells(windows, decay=(half_life_decay(half_life), window - 1), places=window)
    return mirrored(met.select(*KEYS, ((s("xy") - s("x") * s("y")) * per_year).alias("cov")))


def ew_variance(windows: DataFrame, half_life: float, floor: float = FLOOR) -> DataFrame:
    """v_k = b v_(k-1) + (1-b) x_k^2 from v_0 = max(x_0^2, floor), as b^k times a running sum."""
    b = F.lit(half_life_decay(half_life))
    x2 = F.col("ret") * F.col("ret")
    term = F.when(F.col("k") == 0, F.greatest(x2, F.lit(floor))).otherwise((1 - b) * x2 / F.pow(b, F.col("k")))
    run = Window.partitionBy("as_of", "asset").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumn("var", F.pow(b, F.col("k")) * F.sum(term).over(run))


def last_ew_variance(rows: DataFrame, keys: list[str], window: int, half_life: float, floor: float = FLOOR) -> DataFrame:
    """The variance at the end of each window, as one weighted sum per key; rows: keys, k, ret."""
    b = half_life_decay(half_life)
    x2 = F.col("ret") * F.col("ret")
    term = F.when(F.col("k") == 0, F.greatest(x2, F.lit(floor)) * b ** (window - 1)).otherwise((1 - b) * x2 * F.pow(F.lit(b), window - 1 - F.col("k")))
    return rows.groupBy(*keys).agg(F.sum(term).alias("var"))


def cov_iewma(windows: DataFrame, window: int, per_year: int, vol_half_life: float, cor_half_life: float, clip: float = CLIP) -> DataFrame:
    """Volatilities and correlations decay apart: correlations of returns over the prior
    row's volatility, clipped, starting from the identity."""
    v = ew_variance(windows, vol_half_life)
    order = Window.partitionBy("as_of", "asset").orderBy("k")
    z = F.col("ret") / F.sqrt(F.lag("var").over(order))
    scaled = v.withColumn("z", F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))).where("k > 0")
    b = half_life_decay(cor_half_life)
    start = F.when(F.col("asset_i") == F.col("asset_j"), b ** (window - 1)).otherwise(0.0)
    c = cells(scaled, "z", (b, window - 1), window).select(*KEYS, ((1 - b) * F.col("xy") + start).alias("c"))
    last = v.where(F.col("k") == window - 1).select("as_of", "asset", "var")
    own = c.where("asset_i = asset_j").select("as_of", F.col("asset_i").alias("asset"), F.col("c").alias("own")).join(last, ["as_of", "asset"])
    left = own.select("as_of", F.col("asset").alias("asset_i"), F.col("own").alias("ci"), F.col("var").alias("vi"))
    right = own.select("as_of", F.col("asset").alias("asset_j"), F.col("own").alias("cj"), F.col("var").alias("vj"))
    joined = c.join(left, ["as_of", "asset_i"]).join(right, ["as_of", "asset_j"])
    return mirrored(joined.select(*KEYS, (F.col("c") / F.sqrt(F.col("ci") * F.col("cj")) * F.sqrt(F.col("vi") * F.col("vj")) * per_year).alias("cov")))


def cov_ledoit_wolf(windows: DataFrame, window: int, per_year: int) -> DataFrame:
    """Shrinkage to the scaled identity; every term is a sum over rows or cells."""
    n_rows = float(window)
    centred = windows.withColumn("ret", F.col("ret") - F.avg("ret").over(Window.partitionBy("as_of", "asset")))
    s = mirrored(cells(centred, places=window).select(*KEYS, (F.col("xy") / n_rows).alias("s")))
    norms = s.groupBy("as_of").agg(F.sum(F.col("s") * F.col("s")).alias("f2"), F.sum(F.when(F.col("asset_i") == F.col("asset_j"), F.col("s"))).alias("tr"), F.count_distinct("asset_i").cast("double").alias("n"))
    fourth = centred.groupBy("as_of", "k").agg(F.sum(F.col("ret") * F.col("ret")).alias("q")).groupBy("as_of").agg(F.sum(F.col("q") * F.col("q")).alias("q4"))
    m = norms.join(fourth, "as_of").withColumn("mu", F.col("tr") / F.col("n"))
    beta = (F.col("q4") / n_rows - F.col("f2")) / (F.col("n") * n_rows)
    delta = (F.col("f2") - 2 * F.col("mu") * F.col("tr") + F.col("n") * F.col("mu") * F.col("mu")) / F.col("n")
    clamped = F.least(F.greatest(beta, F.lit(0.0)), F.greatest(delta, F.lit(0.0)))
    m = m.select("as_of", "mu", F.when(delta > 0, clamped / delta).otherwise(0.0).alias("shrinkage"))
    target = F.when(F.col("asset_i") == F.col("asset_j"), F.col("mu")).otherwise(0.0)
    return s.join(m, "as_of").select(*KEYS, "shrinkage", (((1 - F.col("shrinkage")) * F.col("s") + F.col("shrinkage") * target) * per_year).alias("cov"))


def volatilities(cov: DataFrame) -> DataFrame:
    return cov.where("asset_i = asset_j").select("as_of", F.col("asset_i").alias("asset"), F.sqrt("cov").alias("vol"))


def quadratic_risk(weights: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """sqrt(w' C w) per key set; weights: keys.., as_of, asset, weight."""
    on = list(dict.fromkeys([*keys, "as_of"]))
    left = weights.select(*on, F.col("asset").alias("asset_i"), F.col("weight").alias("wi"))
    right = weights.select(*on, F.col("asset").alias("asset_j"), F.col("weight").alias("wj"))
    cells = left.join(cov, ["as_of", "asset_i"]).join(right, [*on, "asset_j"])
    return cells.groupBy(on).agg(F.sqrt(F.greatest(F.sum(F.col("wi") * F.col("wj") * F.col("cov")), F.lit(0.0))).alias("risk"))


def correlation(windows: DataFrame, window: int | None = None) -> DataFrame:
    """Pearson, clipped to [-1, 1], and the distance sqrt((1 - rho) / 2)."""
    c = mirrored(cells(windows, places=window).select(*KEYS, pearson().alias("rho")))
    return c.withColumn("distance", F.when(F.col("asset_i") == F.col("asset_j"), 0.0).otherwise(F.sqrt(F.greatest((1 - F.col("rho")) / 2, F.lit(0.0)))))


def covariance_faults(cov: DataFrame) -> DataFrame:
    """Per date what a solver must refuse: cells missing or not finite, the largest
    asymmetry, cells beyond the product of their volatilities (no such matrix is PSD)."""
    other = cov.select("as_of", F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"), F.col("cov").alias("mirror"))
    own = cov.where("asset_i = asset_j").select("as_of", "asset_i", F.col("cov").alias("vi"))
    j = cov.join(other, KEYS, "left").join(own, ["as_of", "asset_i"], "left").join(own.select("as_of", F.col("asset_i").alias("asset_j"), F.col("vi").alias("vj")), ["as_of", "asset_j"], "left")
    bad = F.col("cov").isNull() | F.isnan("cov") | (F.abs("cov") == float("inf"))
    out = j.groupBy("as_of").agg(F.count_distinct("asset_i").alias("assets"), F.count("*").alias("cells"), F.count_if(bad).alias("not_finite"), F.max(F.abs(F.col("cov") - F.coalesce("mirror", F.lit(float("inf"))))).alias("asymmetry"), F.count_if((F.col("vi") < 0) | (F.col("cov") * F.col("cov") > F.col("vi") * F.col("vj") * (1 + 1e-9))).alias("beyond"))
    valid = (F.col("cells") == F.col("assets") * F.col("assets")) & (F.col("not_finite") == 0) & (F.col("asymmetry") <= 1e-10) & (F.col("beyond") == 0)
    return out.withColumn("valid", valid)
