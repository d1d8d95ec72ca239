"""Medians of everything strictly before a date, for every date of long series.

A series is cut into blocks of time and, by a sketch of its values, into buckets of ranks.
How many earlier values lie in each bucket is a prefix sum over blocks, and tells which
buckets hold the middle of all that came before a block. Within a block of S rows the median
moves past S / 2 of those values at most, on either side; so a block takes along these few,
as many values having been left out below as above, which leaves its medians what they are. Steps
within a block do the same with the block's rows. Each step is then a small window of its
own, and no task holds a series.

Cases: null values count as none, and have a median themselves; the first row has none; ties
are values of their own; dates do not repeat within a series; no rows, no medians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at least; a longer series has blocks of the square root of its length,
#: so that blocks times buckets stay below its rows. Rows of a step inside a long series'
#: blocks.
ROWS, STEP = 512, 32


def _place(cuts: Column, x: Column, steps: int) -> Column:
    """How many of the sorted cuts are at most x, by halving."""
    mid = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    right = lambda a: F.get(cuts, mid(a)) <= x
    step = lambda a, _: F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(right(a), mid(a) + 1).otherwise(a["lo"]).alias("lo"), F.when(right(a), a["hi"]).otherwise(mid(a)).alias("hi")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), step)["lo"]


def _carried(rows: DataFrame) -> DataFrame:
    """asset, block, ret: for each block the values around the middle of all blocks before.
    rows: asset, block, bucket, blocks, ret, none null."""
    counts = rows.groupBy("asset", "block", "bucket").agg(F.count("*").alias("n"))
    grid = rows.select("asset", "blocks").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = grid.join(counts, ["asset", "block", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    earlier = Window.partitionBy("asset", "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    block = Window.partitionBy("asset", "block")
    lower = block.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({"start": F.coalesce(F.sum("before").over(lower), F.lit(0)), "total": F.sum("before").over(block), "own": F.sum("n").over(block)})
    left_out = F.greatest(F.lit(0), F.floor(F.col("total") / 2) - F.ceil(F.col("own") / 2) - 2)
    middle = full.withColumn("skip", left_out).where("before > 0 AND start < total - skip AND start + before > skip").select("asset", "bucket", "block", "start", "total", "skip")
    values = rows.groupBy("asset", "bucket", F.col("block").alias("of"), "ret").agg(F.count("*").alias("n"))
    met = middle.join(values, ["asset", "bucket"]).where("of < block")
    order = Window.partitionBy("asset", "block").orderBy("bucket", "ret", "of").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("start").over(block) + F.coalesce(F.sum("n").over(order), F.lit(0))
    met = met.withColumn("first", first)
    copies = F.least(F.col("first") + F.col("n"), F.col("total") - F.col("skip")) - F.greatest("first", "skip")
    return met.withColumn("copies", copies.cast("int")).where("copies > 0").select("asset", "block", F.explode(F.array_repeat("ret", F.col("copies"))).alias("ret"))


def _stepped(rows: DataFrame, step: int) -> DataFrame:
    """The same once more inside blocks, plainly: every step of so many rows takes along the
    middle of what its block had before. rows: asset, block, date (null of what the block
    itself took along), ret."""
    at = Window.partitionBy("asset", "block").orderBy(F.col("date").asc_nulls_first())
    own = rows.withColumn("row", F.count("date").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("step", F.when(F.col("date").isNull(), F.lit(-1)).otherwise(F.floor((F.col("row") - 1) / step))).withColumn("last", F.max("step").over(Window.partitionBy("asset", "block")))
    past = own.where("ret IS NOT NULL AND step < last").select("asset", "block", "ret", F.explode(F.sequence(F.col("step") + 1, F.col("last"))).alias("step"))
    within = Window.partitionBy("asset", "block", "step")
    past = past.withColumns({"place": F.row_number().over(within.orderBy("ret")) - 1, "total": F.count("*").over(within)})
    skip = F.greatest(F.lit(0), F.floor(F.col("total") / 2) - step // 2 - 3)
    past = past.where((F.col("place") >= skip) & (F.col("place") < F.col("total") - skip)).select("asset", "block", "step", F.lit(None).cast("date").alias("date"), "ret")
    return own.where("date IS NOT NULL").select("asset", "block", "step", "date", "ret").unionByName(past)


def expanding_median(panel: DataFrame, least: int = ROWS) -> DataFrame:
    """date, asset, med: the median of the asset's returns strictly before date, null on its
    first."""
    rows = panel.select("date", "asset", "ret")
    sizes = rows.groupBy("asset").agg(F.count("*").alias("n"), F.min(F.unix_date("date")).alias("lo"), F.max(F.unix_date("date")).alias("hi"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    size = max(least, math.isqrt(longest))
    most = -(-longest // size)
    if most > 1:
        cuts = rows.groupBy("asset").agg(F.percentile_approx("ret", [i / most for i in range(1, most)], 20 * most).alias("cuts"))
        known = sizes.join(cuts, "asset").withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
        met = rows.join(known, "asset")
        width = F.ceil((F.col("hi") - F.col("lo") + 1) / F.col("blocks"))
        block = F.floor((F.unix_date("date") - F.col("lo")) / width).cast("int")
        bucket = F.floor(_place(F.coalesce("cuts", F.array().cast("array<double>")), F.col("ret"), most.bit_length() + 1) * F.col("blocks") / most).cast("int")
        rows = met.select("date", "asset", "ret", "blocks", block.alias("block"), bucket.alias("bucket"))
        carried = _carried(rows.where("ret IS NOT NULL").drop("date"))
        rows = _stepped(rows.select("date", "asset", "ret", "block").unionByName(carried.withColumn("date", F.lit(None).cast("date"))), STEP)
    else:
        rows = rows.withColumns({"block": F.lit(0), "step": F.lit(0)})
    so_far = Window.partitionBy("asset", "block", "step").orderBy(F.col("date").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("med", F.percentile("ret", F.lit(0.5)).over(so_far)).where("date IS NOT NULL").select("date", "asset", "med")
