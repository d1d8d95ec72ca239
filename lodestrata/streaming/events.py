"""The panel's information rules on a stream of events (ts, user_id, event_type, value).

Nothing at or after a boundary is visible in batch; on a stream the watermark plays that
part: a window is emitted once, when no row of it can come any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Decision periods: per window and type, count, sum and mean of values."""
    return _stats(events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type"))


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """Rolling statistics by time: windows of ``width`` every ``step``."""
    return _stats(events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type"))


def _stats(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total", "mean")


STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("wealth", T.DoubleType()), T.StructField("peak", T.DoubleType()), T.StructField("drawdown", T.DoubleType())])


def running_wealth(events: DataFrame, scale: float = 1e-4) -> DataFrame:
    """Sequential state per user: wealth compounds value * scale in time order within each
    trigger; the running maximum and the largest drawdown are kept. Emits the state after
    every trigger that brought rows."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, wealth, peak, drawdown = state.get if state.exists else (0, 1.0, 1.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for v in rows["value"].fillna(0.0):
            wealth *= 1 + v * scale
            peak = max(peak, wealth)
            drawdown = min(drawdown, wealth / peak - 1)
        n += len(rows)
        state.update((n, wealth, peak, drawdown))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "wealth": [wealth], "peak": [peak], "drawdown": [drawdown]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, wealth double, peak double, drawdown double", STATE, "update", "NoTimeout")
