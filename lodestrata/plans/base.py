"""The test panels, in Spark and in the SQL that checks it, and how queries register."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import asof
from lodestrata.sources import panels

W, PER_YEAR = 52, 52
MEAN_HALF_LIFE, VOL_HALF_LIFE, COR_HALF_LIFE = 13.0, 13.0, 26.0
SHRINK, CAP, TREND, VOL = 0.5, 0.2, 26, 13

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = f"""
WITH raw_panel AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 'L' || l_linenumber AS asset, avg(l_discount) - 0.05 AS ret
  FROM lineitem GROUP BY 1, 2),
panel AS (
  SELECT * FROM raw_panel WHERE date IN (SELECT date FROM raw_panel GROUP BY date HAVING count(*) = (SELECT count(DISTINCT asset) FROM raw_panel))),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel)),
firsts AS (SELECT min(date) AS as_of, min(pos) AS pos FROM cal GROUP BY date_trunc('quarter', date)),
sched AS (SELECT as_of, pos, lead(as_of) OVER (ORDER BY as_of) AS next_as_of FROM firsts WHERE pos >= {W}),
win AS (
  SELECT s.as_of, c.pos - s.pos + {W} AS k, p.date, p.asset, p.ret
  FROM sched s JOIN cal c ON c.pos >= s.pos - {W} AND c.pos < s.pos JOIN panel p ON p.date = c.date),
cls AS (SELECT DISTINCT asset, 'C' || (CAST(substr(asset, 2) AS INTEGER) % 3) AS asset_class FROM panel),
hold AS (
  SELECT s.as_of, p.date, p.asset, p.ret FROM panel p JOIN sched s ON p.date > s.as_of AND (s.next_as_of IS NULL OR p.date <= s.next_as_of)),
px AS (
  SELECT CAST(l_shipdate AS DATE) AS date, 'L' || l_linenumber AS asset, sum(l_extendedprice) / sum(l_quantity) AS px
  FROM lineitem GROUP BY 1, 2),
grid AS (
  SELECT d.date, a.asset, px.px FROM (SELECT DISTINCT date FROM px) d CROSS JOIN (SELECT DISTINCT asset FROM px) a LEFT JOIN px ON px.date = d.date AND px.asset = a.asset),
wide AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS asset, avg(l_discount) - 0.05 AS ret
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
mkt AS (SELECT date, avg(ret) AS ret FROM panel GROUP BY date)
"""


class Tables:
    """The same relations as BASE, as DataFrames. What several plans share is written once
    to the shared folder, so that lineitem is read once and plans stay small."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def once(self, df: DataFrame) -> DataFrame:
        path = panels.work_dir(self.spark)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        return panels.read(self.spark, self.dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return self.once(panels.weekly_returns(self.spark, self.dir))

    @cached_property
    def panel(self) -> DataFrame:
        return self.once(panels.complete_dates(self.raw))

    @cached_property
    def sched(self) -> DataFrame:
        return self.once(asof.quarter_schedule(self.panel, W))

    @cached_property
    def win(self) -> DataFrame:
        return self.once(asof.training_windows(self.panel, self.sched, W))

    @cached_property
    def hold(self) -> DataFrame:
        return self.once(asof.holding_rows(self.panel, self.sched))

    @property
    def cls(self) -> DataFrame:
        return panels.asset_classes(self.panel)

    @cached_property
    def px(self) -> DataFrame:
        return self.once(panels.daily_prices(self.spark, self.dir))

    @cached_property
    def wide(self) -> DataFrame:
        return self.once(panels.weekly_brand_returns(self.spark, self.dir))

    @property
    def mkt(self) -> DataFrame:
        return self.panel.groupBy("date").agg(F.avg("ret").alias("ret"))


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, -0 as 0; counts as bigint: sums depend on their order. A small
    shift keeps values that end in an exact half from going either way."""
    def fix(name: str, kind: str):
        c = F.col(f"`{name}`")
        return (F.round(c + 3.1 * 10.0 ** -(digits + 3), digits) + 0.0 if kind == "double" else c.cast("long") if kind in ("int", "bigint") else c).alias(name)

    return df.select(*[fix(n, k) for n, k in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", ints: str = "", digits: int = 8):
    """Register f(Tables) -> DataFrame under name; sql may use the relations of BASE."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _rounded(f(Tables(spark, sf_dir)), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            fixes = [f"round({c} + {3.1 * 10.0 ** -(digits + 3)!r}, {digits}) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            replaced = f" REPLACE ({', '.join(fixes)})" if fixes else ""
            body = sql.strip()
            if body.startswith(","):
                ctes, _, final = body.rpartition("FINAL")
                ORACLE_SQL[name] = f"{BASE}{ctes}\nSELECT *{replaced} FROM ({final.strip()}) AS q_"
            else:
                ORACLE_SQL[name] = f"{BASE}\nSELECT *{replaced} FROM ({body}) AS q_"
        return f

    return add
