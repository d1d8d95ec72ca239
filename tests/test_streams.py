"""Windows lose no row, in whatever order files come."""

from pyspark.sql import functions as F

from lodestrata.plans import streams as S
from lodestrata.plans.base import Tables
from lodestrata.streaming import events as E


def test_files_out_of_time_order_lose_no_row(spark, tmp_path):
    rows = spark.range(64).select(F.col("id").alias("event_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(30 * (63 - id)))").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    rows.repartitionByRange(8, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    done = S._finished(t, E.tumbling(S._events(t, 1), "1 day", S._lateness(t))).where("event_type = 'a'")
    assert done.agg(F.sum("n")).first()[0] == 64
