"""Panels: long rows (date, asset, ret), and where they come from and go to."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = T.StructType([T.StructField("asset", T.StringType()), T.StructField("asset_class", T.StringType()), T.StructField("downloaded", T.BooleanType()), T.StructField("missing_fraction", T.DoubleType()), T.StructField("first_valid_date", T.DateType()), T.StructField("last_valid_date", T.DateType()), T.StructField("kept", T.BooleanType())])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow test panel: one asset a line number, weekly, from lineitem."""
    week = F.date_trunc("week", "l_shipdate").cast("date").alias("date")
    asset = F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("asset")
    return read(spark, sf_dir, "lineitem").groupBy(week, asset).agg((F.avg("l_discount") - 0.05).alias("ret"))


def weekly_brand_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide test panel: one asset a brand. Lineitem meets part on the part key."""
    week = F.date_trunc("week", "l_shipdate").cast("date").alias("date")
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(week, F.col("p_brand").alias("asset")).agg((F.avg("l_discount") - 0.05).alias("ret"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices with gaps: (date, asset, px)."""
    day, asset = F.to_date("l_shipdate").alias("date"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("asset")
    return read(spark, sf_dir, "lineitem").groupBy(day, asset).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("px"))


def complete_dates(panel: DataFrame) -> DataFrame:
    """Only the dates on which every asset of the panel has a row."""
    need = panel.agg(F.count_distinct("asset").alias("need"))
    have = panel.groupBy("date").agg(F.count("asset").alias("have"))
    full = have.join(F.broadcast(need), F.col("have") == F.col("need")).select("date")  # need is one row
    return panel.join(full, "date", "left_semi")


def asset_class(asset: Column) -> Column:
    """Test classes: the number in the asset's name, modulo 3."""
    return F.concat(F.lit("C"), (F.regexp_extract(asset, r"(\d+)$", 1).cast("int") % 3).cast("string"))


def asset_classes(panel: DataFrame) -> DataFrame:
    return panel.select("asset").distinct().withColumn("asset_class", asset_class(F.col("asset")))


def melt(wide: DataFrame, key: str = "date", value: str = "ret") -> DataFrame:
    """Wide columns to long rows; empty cells are dropped."""
    columns = [c for c in wide.columns if c != key]
    return wide.unpivot([key], columns, "asset", value).where(F.col(value).isNotNull())


def read_wide_csv(spark: SparkSession, path: str, value: str = "ret") -> DataFrame:
    """A wide CSV with a date column and one column an asset. Duplicate dates fail the scan."""
    raw = spark.read.csv(path, header=True)
    key = raw.columns[0]
    typed = raw.select(F.to_date(key).alias("date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns[1:]])
    twice = typed.groupBy("date").agg(F.count("*").alias("n")).select(F.assert_true((F.max("n") <= 1) & F.max("date").isNotNull(), "dates repeat, or there are none").alias("ok"))
    return melt(typed.join(F.broadcast(twice), F.col("ok").isNull()).drop("ok"), value=value)  # twice is one row


def write_wide_csv(panel: DataFrame, path: str, value: str = "ret") -> None:
    panel.groupBy("date").pivot("asset").agg(F.first(value)).write.csv(path, header=True)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, keys in name order, NaN and infinities as null."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return df.select(F.to_json(F.struct(*[(finite(c) if c in doubles else F.col(c)).alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("json"))


def canonical_json(payload: dict) -> str:
    """Sorted, compact, NaN as null: what configuration hashes are taken of."""
    def clean(x):
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [clean(v) for v in x]
        return None if isinstance(x, float) and not math.isfinite(x) else x

    return json.dumps(clean(payload), sort_keys=True, separators=(",", ":"))


def work_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared folder; a temporary one where none is
    set and Spark runs on this machine alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
