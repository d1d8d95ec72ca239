"""The information boundary of a decision, on two streams.

A decision asks for an asset's returns strictly before its date, as far back as a window
goes. Decisions and returns meet in a stream-stream join whose bound on time tells Spark
when a row can meet no more: both sides leave the state once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(decisions: DataFrame, returns: DataFrame, days: int, late: str) -> DataFrame:
    """as_of, asset, date, ret of the returns a decision may know. decisions: as_of, asset;
    returns: date, asset, ret; times are timestamps."""
    asked = decisions.withWatermark("as_of", late)
    known = returns.withWatermark("date", late).withColumnRenamed("asset", "known_asset")
    met = asked.join(known, (asked.asset == known.known_asset) & (known.date < asked.as_of) & (known.date >= asked.as_of - F.expr(f"INTERVAL {days} DAYS")))
    return met.select("as_of", "asset", "date", "ret")

