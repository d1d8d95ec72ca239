"""Heuristic weights and the algebra of robust returns, as SQL plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_weight(assets: DataFrame, cap: float | None = None) -> DataFrame:
    """assets: as_of, asset. Fails where 1/N is above the cap."""
    w = 1.0 / F.count("*").over(Window.partitionBy("as_of"))
    out = assets.select("as_of", "asset", w.alias("weight"))
    if cap is None:
        return out
    return out.where(F.coalesce(F.assert_true(F.col("weight") <= cap + 1e-12, "equal weight above the cap").cast("boolean"), F.lit(True)))


def class_equal_weight(assets: DataFrame, classes: DataFrame) -> DataFrame:
    """1 / (number of classes x assets of the class); an asset without a class fails."""
    known = F.coalesce("asset_class", F.raise_error(F.lit("asset without a class")).cast("string"))
    joined = assets.join(classes, "asset", "left").withColumn("asset_class", known)
    per_class = joined.groupBy("as_of", "asset_class").agg(F.count("*").alias("n")).withColumn("k", F.count("*").over(Window.partitionBy("as_of")))
    return joined.join(per_class, ["as_of", "asset_class"]).select("as_of", "asset", (1.0 / (F.col("k") * F.col("n"))).alias("weight"))


def capped_proportional(scores: DataFrame, cap: float) -> DataFrame:
    """Weights in proportion to positive scores, none above cap, the rest shared out again.

    Those capped are a prefix in falling score, so the fixed point has a closed form: the
    first rank r at which (1 - (r-1) cap) score_r / (scores from r on) is within the cap.
    """
    order = Window.partitionBy("as_of").orderBy(F.desc("score"), "asset")
    tail = order.rowsBetween(0, Window.unboundedFollowing)
    ranked = scores.withColumns({"r": F.row_number().over(order), "rest": F.sum("score").over(tail), "n": F.count("*").over(Window.partitionBy("as_of"))})
    feasible = F.coalesce(F.assert_true(F.col("n") * cap >= 1 - 1e-12, "cap times assets is under 1").cast("boolean"), F.lit(True))
    share = (1 - (F.col("r") - 1) * cap) * F.col("score") / F.col("rest")
    ranked = ranked.where(feasible).withColumn("fits", share <= cap + 1e-15)
    cut = ranked.where("fits").groupBy("as_of").agg(F.min(F.struct("r", "rest")).alias("cut"))
    w = F.when(F.col("cut").isNull() | (F.col("r") < F.col("cut.r")), F.lit(cap)).otherwise((1 - (F.col("cut.r") - 1) * cap) * F.col("score") / F.col("cut.rest"))
    return ranked.join(cut, "as_of", "left").select("as_of", "asset", w.alias("weight"))


def inverse_volatility(vols: DataFrame, cap: float) -> DataFrame:
    """vols: as_of, asset, vol."""
    return capped_proportional(vols.select("as_of", "asset", (1.0 / F.col("vol")).alias("score")), cap)


def box_return(mu: Column, weight: Column, se: Column, rho: float) -> Column:
    """Aggregate: expected return at the worst corner of the box."""
    return F.sum(mu * weight) - rho * F.sum(F.abs(se * weight))


def diagonal_robust(cov: DataFrame, kappa: float) -> DataFrame:
    own = F.when(F.col("asset_i") == F.col("asset_j"), 1 + kappa).otherwise(1.0)
    return cov.withColumn("cov", F.col("cov") * own)


def weights_ok(weights: DataFrame, keys: list[str], cap: float, tol: float = 5e-7) -> DataFrame:
    """Per key: sum_residual, lower_violation, cap_violation, valid."""
    sums = weights.groupBy(keys).agg((F.sum("weight") - 1).alias("sum_residual"), F.greatest(-F.min("weight"), F.lit(0.0)).alias("lower_violation"), F.greatest(F.max("weight") - cap, F.lit(0.0)).alias("cap_violation"))
    return sums.withColumn("valid", (F.abs("sum_residual") <= tol) & (F.col("lower_violation") <= tol) & (F.col("cap_violation") <= tol))


def allocation_diagnostics(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: L1 distance, cosine, concentration and effective number of both sides.
    left and right: keys.., asset, weight; an absent asset weighs 0."""
    on = [*keys, "asset"]
    both = left.withColumnRenamed("weight", "a").join(right.withColumnRenamed("weight", "b"), on, "full").fillna(0.0, ["a", "b"])
    s = lambda e: F.sum(e)
    out = both.groupBy(keys).agg(s(F.abs(F.col("b") - F.col("a"))).alias("l1"), s(F.col("a") * F.col("b")).alias("ab"), s(F.col("a") * F.col("a")).alias("hhi_a"), s(F.col("b") * F.col("b")).alias("hhi_b"))
    norm = F.sqrt(F.col("hhi_a") * F.col("hhi_b"))
    return out.select(*keys, "l1", F.when(norm > 0, F.col("ab") / norm).alias("cosine"), "hhi_a", "hhi_b", (1 / F.col("hhi_a")).alias("effective_a"), (1 / F.col("hhi_b")).alias("effective_b"))


def exposure(weights: DataFrame, groups: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Weights summed by a group of assets; groups: asset, <group>."""
    return weights.join(groups, "asset").groupBy(*keys, group).agg(F.sum("weight").alias("exposure"))


def exposure_change(left: DataFrame, right: DataFrame, groups: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Sum over groups of the absolute change of exposure."""
    a = exposure(left, groups, keys, group).withColumnRenamed("exposure", "a")
    b = exposure(right, groups, keys, group).withColumnRenamed("exposure", "b")
    both = a.join(b, [*keys, group], "full").fillna(0.0, ["a", "b"])
    return both.groupBy(keys).agg(F.sum(F.abs(F.col("b") - F.col("a"))).alias("exposure_l1"))


def fold_clone(weights: DataFrame, clone: str, source: str, keys: list[str]) -> DataFrame:
    """A clone's weight counts for its source."""
    asset = F.when(F.col("asset") == clone, source).otherwise(F.col("asset")).alias("asset")
    return weights.groupBy(*keys, asset).agg(F.sum("weight").alias("weight"))


def clean_weights(raw: DataFrame, keys: list[str], cap: float, tol: float = 1e-6) -> DataFrame:
    """A solver's weights made exact: clipped to [0, cap], the sum's gap to 1 given to the
    asset with most room, or taken from the largest. Fails on gaps beyond tol."""
    inside = F.assert_true(F.col("weight").between(-tol, cap + tol), "weights break their bounds").isNull()
    group = Window.partitionBy(*keys)
    clipped = raw.where(inside).withColumn("weight", F.greatest(F.least("weight", F.lit(cap)), F.lit(0.0))).withColumn("gap", 1 - F.sum("weight").over(group))
    closed = F.assert_true(F.abs("gap") <= tol, "weights do not sum to 1").isNull()
    room = F.round(F.when(F.col("gap") > 0, cap - F.col("weight")).otherwise(F.col("weight")), 12)
    ranked = clipped.where(closed).withColumn("r", F.row_number().over(group.orderBy(room.desc(), "asset")))
    return ranked.select(*keys, "asset", F.when(F.col("r") == 1, F.col("weight") + F.col("gap")).otherwise(F.col("weight")).alias("weight"))


def worst_means(weights: DataFrame, mu: DataFrame, se: DataFrame, mean_cov: DataFrame, rho: float) -> DataFrame:
    """as_of, asset, weight, box_mu, ellipsoid_mu: where the inner problems attain their
    minimum, the box at a corner, the ellipsoid along the covariance times the weights.
    mu: as_of, asset, mu; se: as_of, asset, se; mean_cov: as_of, asset_i, asset_j, cov."""
    right = weights.select("as_of", F.col("asset").alias("asset_j"), F.col("weight").alias("wj"))
    cw = mean_cov.join(right, ["as_of", "asset_j"]).groupBy("as_of", F.col("asset_i").alias("asset")).agg(F.sum(F.col("cov") * F.col("wj")).alias("cw"))
    j = weights.join(mu, ["as_of", "asset"]).join(se, ["as_of", "asset"]).join(cw, ["as_of", "asset"])
    risk = F.sqrt(F.greatest(F.sum(F.col("weight") * F.col("cw")).over(Window.partitionBy("as_of")), F.lit(0.0)))
    j = j.withColumn("risk", risk)
    return j.select("as_of", "asset", "weight", (F.col("mu") - rho * F.col("se") * F.signum("weight")).alias("box_mu"), (F.col("mu") - F.when(F.col("risk") > 0, rho * F.col("cw") / F.col("risk")).otherwise(0.0)).alias("ellipsoid_mu"))


def solved_inner_problems(weights: DataFrame, mu: DataFrame, se: DataFrame, mean_cov: DataFrame, rho: float, kappa: float, steps: int = 60) -> DataFrame:
    """as_of, model, closed, solved: the worst case by its closed form, and by solving the
    inner problem without it. Box and diagonal split by asset, where the better of the two
    ends is looked for. The ellipsoid is climbed: from an even start, each step goes along
    the gradient, as far as the surface is from its middle, and back onto the surface."""
    j = weights.join(mu, ["as_of", "asset"]).join(se, ["as_of", "asset"])
    ends = j.withColumn("e", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    worst = ends.groupBy("as_of", "asset").agg(F.min(F.col("weight") * (F.col("mu") + F.col("e") * rho * F.col("se"))).alias("worst")).groupBy("as_of").agg(F.sum("worst").alias("solved"))
    box = j.groupBy("as_of").agg(box_return(F.col("mu"), F.col("weight"), F.col("se"), rho).alias("closed")).join(worst, "as_of").withColumn("model", F.lit("box"))
    wi = weights.select("as_of", F.col("asset").alias("asset_i"), F.col("weight").alias("wi"))
    wj = weights.select("as_of", F.col("asset").alias("asset_j"), F.col("weight").alias("wj"))
    cells = mean_cov.join(wi, ["as_of", "asset_i"]).join(wj, ["as_of", "asset_j"])
    part, own = F.col("cov") * F.col("wi") * F.col("wj"), F.col("asset_i") == F.col("asset_j")
    most = cells.withColumn("e", F.explode(F.when(own, F.array(F.lit(-1.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0))))).groupBy("as_of", "asset_i", "asset_j").agg(F.max((1 + F.col("e") * kappa) * part).alias("most"))
    diagonal = cells.groupBy("as_of").agg(F.sum(F.when(own, 1 + kappa).otherwise(1.0) * part).alias("closed")).join(most.groupBy("as_of").agg(F.sum("most").alias("solved")), "as_of").withColumn("model", F.lit("diagonal"))
    rows = cells.groupBy("as_of", "asset_i", "wi").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset_j", "cov"))), lambda x: x["cov"]).alias("row"))
    packed = rows.groupBy("as_of").agg(F.array_sort(F.collect_list(F.struct("asset_i", "wi", "row"))).alias("x")).join(j.groupBy("as_of").agg(F.sum(F.col("mu") * F.col("weight")).alias("m")), "as_of")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    times = lambda y: F.transform("x", lambda r: dot(r["row"], y))
    onto = lambda y: F.transform(y, lambda v: v / F.sqrt(dot(y, times(y))))
    w = F.transform("x", lambda r: r["wi"])
    top = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("x", lambda r: F.lit(1.0)), lambda y, _: onto(F.zip_with(y, w, lambda a, b: a + b / F.col("g"))))
    climbed = packed.withColumn("g", F.sqrt(dot(w, times(w)))).withColumn("y", top).select("as_of", F.lit("ellipsoid").alias("model"), (F.col("m") - rho * F.sqrt(dot(w, times(w)))).alias("closed"), (F.col("m") - rho * dot(w, times(F.col("y")))).alias("solved"))
    return box.select("as_of", "model", "closed", "solved").unionByName(diagonal.select("as_of", "model", "closed", "solved")).unionByName(climbed)


def capacity(assets: DataFrame, caps: list[float]) -> DataFrame:
    """as_of, cap, assets, feasible: whether the assets can hold 1 under the cap."""
    n = assets.groupBy("as_of").agg(F.count_distinct("asset").alias("assets"))
    return n.withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).withColumn("feasible", F.col("assets") * F.col("cap") >= 1 - 1e-12)


def validated_targets(weights: DataFrame, keys: list[str], cap: float, tolerance: float = 1e-8) -> DataFrame:
    """Per key: the share left in cash, or why the target is refused. Shorts within the
    tolerance count as zero."""
    w = F.col("weight")
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf"))
    total = F.sum(F.when(w.between(-tolerance, 0.0), 0.0).otherwise(w))
    fault = F.when(~F.bool_and(finite), "NOT_FINITE").when(F.min(w) < -tolerance, "NEGATIVE").when(F.max(w) > cap + tolerance, "ABOVE_CAP").when(total > 1 + tolerance, "ABOVE_ONE")
    out = weights.groupBy(*keys).agg(total.alias("total"), fault.alias("fault"))
    return out.select(*keys, F.when(F.col("fault").isNull(), F.greatest(1 - F.col("total"), F.lit(0.0))).alias("cash"), "fault")
