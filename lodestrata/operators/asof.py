"""Information boundaries: what is known strictly before a date.

Dates become row positions once; a training window is then a range of positions, so an
as-of window is an equi-join on positions, not a range join. The calendar and the
schedule have a row a date and a row a quarter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """date, pos (from 0)."""
    return panel.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def quarter_schedule(panel: DataFrame, window: int) -> DataFrame:
    """First date of each quarter that has ``window`` rows before it: as_of, pos, next_as_of."""
    firsts = calendar(panel).groupBy(F.date_trunc("quarter", "date").alias("q")).agg(F.min("date").alias("as_of"), F.min("pos").alias("pos"))
    return firsts.where(F.col("pos") >= window).select("as_of", "pos", F.lead("as_of").over(Window.orderBy("as_of")).alias("next_as_of"))


def training_windows(panel: DataFrame, schedule: DataFrame, window: int) -> DataFrame:
    """as_of, k (0 .. window-1), date, asset, ret: the last ``window`` dates before as_of."""
    places = schedule.select("as_of", F.posexplode(F.sequence(F.col("pos") - window, F.col("pos") - 1)).alias("k", "pos"))
    return places.join(calendar(panel), "pos").join(panel, "date").select("as_of", "k", "date", "asset", "ret")


def before(panel: DataFrame, as_of: str, assets: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Rows strictly before a date; unknown assets fail, ``rows`` keeps the last dates."""
    seen = panel.where(F.col("date") < F.lit(as_of).cast("date"))
    if assets is not None:
        known = panel.where(F.col("asset").isin(assets)).select("asset").distinct().count()
        if known != len(set(assets)):
            raise KeyError("unknown assets")
        seen = seen.where(F.col("asset").isin(assets))
    if rows is not None:
        seen = seen.withColumn("_r", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))).where(F.col("_r") <= rows).drop("_r")
    return seen


def holding_rows(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Each row with the decision it is held under: as_of < date <= next_as_of (open at the end)."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    marked = calendar(panel).join(schedule.select(F.col("as_of").alias("date"), F.lit(True).alias("hit")), "date", "left")
    held = marked.withColumn("as_of", F.last(F.when(F.col("hit"), F.col("date")), ignorenulls=True).over(w)).where("as_of IS NOT NULL").select("date", "as_of")
    return panel.join(held, "date")


def folds(panel: DataFrame, schedule: DataFrame, window: int) -> DataFrame:
    """Per date: the fit range (last ``window`` rows before) and the validation range
    strictly between it and the next date."""
    cal = calendar(panel)
    fit = schedule.select("as_of", "next_as_of", F.explode(F.sequence(F.col("pos") - window, F.col("pos") - 1)).alias("pos")).join(cal, "pos")
    fit = fit.groupBy("as_of", "next_as_of").agg(F.min("date").alias("fit_start"), F.max("date").alias("fit_end"), F.count("*").alias("fit_rows"))
    val = holding_rows(cal.select("date", F.lit("x").alias("asset"), F.lit(0.0).alias("ret")), schedule)
    val = val.join(schedule.select("as_of", "next_as_of"), "as_of").where(F.col("date") < F.col("next_as_of"))
    val = val.groupBy("as_of").agg(F.min("date").alias("val_start"), F.max("date").alias("val_end"), F.count("*").alias("val_rows"))
    return fit.join(val, "as_of")


def outer_schedule(fold_rows: DataFrame, minimum: int) -> DataFrame:
    """Dates with at least ``minimum`` folds that ended before them: as_of, prior_folds,
    latest_end. A fold has ended when its next date is not after as_of."""
    w = Window.orderBy("as_of").rowsBetween(Window.unboundedPreceding, -1)
    counted = fold_rows.withColumns({"prior_folds": F.count("*").over(w), "latest_end": F.max("val_end").over(w)})
    return counted.where(F.col("prior_folds") >= minimum).select("as_of", "prior_folds", "latest_end")


def survivor_snapshot(windows: DataFrame, declared: DataFrame, required: int) -> DataFrame:
    """Per as_of and declared asset: observed, eligible, reason."""
    seen = windows.groupBy("as_of", "asset").agg(F.count("ret").alias("observed"))
    every = windows.select("as_of").distinct().crossJoin(declared.select("asset"))  # schedule x universe, the result's size
    joined = every.join(seen, ["as_of", "asset"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    reason = F.when(F.col("observed") < required, "INSUFFICIENT_HISTORY")
    return joined.select("as_of", "asset", "observed", reason.isNull().alias("eligible"), reason.alias("reason"))


def point_in_time_snapshot(panel: DataFrame, listing: DataFrame, schedule: DataFrame, required: int) -> DataFrame:
    """Eligibility with listing and inactive dates (listed strictly before, active until
    strictly after). listing: asset, listing_date, inactive_date."""
    later = Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)  # a row a date
    marked = calendar(panel).join(schedule.select(F.col("as_of").alias("date"), F.lit(True).alias("hit")), "date", "left")
    nexts = marked.select("date", F.last(F.when(F.col("hit"), F.col("date")), ignorenulls=True).over(later).alias("as_of")).where("as_of IS NOT NULL")
    # a date counts once, at the first decision after it; running sums carry it on
    fresh = panel.select("asset", "date").distinct().join(nexts, "date").groupBy("as_of", "asset").agg(F.count("*").alias("n"))
    every = schedule.select("as_of").crossJoin(listing)  # schedule x universe, the result's size
    upto = Window.partitionBy("asset").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    rows = every.join(fresh, ["as_of", "asset"], "left").withColumn("observed", F.sum(F.coalesce("n", F.lit(0))).over(upto))
    reason = (F.when(F.col("listing_date") >= F.col("as_of"), "NOT_LISTED").when(F.col("inactive_date") <= F.col("as_of"), "INACTIVE")
              .when(F.col("observed") == 0, "NO_HISTORY").when(F.col("observed") < required, "INSUFFICIENT_HISTORY"))
    return rows.select("as_of", "asset", "observed", reason.isNull().alias("eligible"), reason.alias("reason"))
