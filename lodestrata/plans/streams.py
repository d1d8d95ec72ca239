"""Streaming queries over events, run to completion over the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.plans.base import Tables, query
from lodestrata.plans.research import _BOOKS, _PATHS, _books
from lodestrata.sources.panels import work_dir
from lodestrata.streaming import boundary, portfolio
from lodestrata.streaming import events as E


def _finished(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Write the stream to Parquet under a checkpoint until the input is used up."""
    out, marks = work_dir(t.spark), work_dir(t.spark)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


#: Pieces of a table that come one after another, as files of a stream would.
PIECES = 8


def _cuts(df: DataFrame, column: str) -> list[float]:
    """Times, in seconds, that part the table into PIECES of about as many rows."""
    at = F.col(column).cast("timestamp").cast("double")
    return df.agg(F.percentile_approx(at, [i / PIECES for i in range(PIECES + 1)], 1000).alias("cuts")).first().cuts or [0.0]


def _in_order(df: DataFrame, column: str, folder: str, cuts: list[float]) -> None:
    """Write df in pieces by time: a later piece's files are the younger ones."""
    at = F.col(column).cast("timestamp").cast("double")
    inner = sorted(set(cuts[1:-1]))
    for i in range(len(inner) + 1):
        from_, to = (at >= inner[i - 1]) if i else F.lit(True), (at < inner[i]) if i < len(inner) else F.lit(True)
        df.where(from_ & to).write.mode("append").parquet(folder)


def _late(cuts: list[float]) -> str:
    """How late a row can be: the files of a piece come in any order, pieces do not."""
    return f"{int(max((b - a for a, b in zip(cuts, cuts[1:], strict=False)), default=0)) + 3600} seconds"


def _events(t: Tables, files_per_batch: int = 1000) -> DataFrame:
    """The events table as a folder stream; its last window closes when a row past it comes."""
    folder = work_dir(t.spark)
    rows = t.read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    _in_order(rows, "ts", f"{folder}/a", _cuts(rows, "ts"))
    last = rows.agg(F.max("ts").alias("ts"), F.min("ts").alias("low")).select(F.lit(-1).cast("long").alias("event_id"), F.expr("ts + (ts - low) + INTERVAL 400 DAYS").alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
    last.write.parquet(f"{folder}/b")
    return E.read_events(t.spark, f"{folder}/*", files_per_batch)


def _lateness(t: Tables) -> str:
    return _late(_cuts(t.read("events"), "ts"))


_WINDOW = "SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS DATE) AS day, event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean FROM events GROUP BY 1, 2"


@query("STR03_tumbling_windows", _WINDOW, "total mean", "n", digits=6)
def _(t: Tables) -> DataFrame:
    done = _finished(t, E.tumbling(_events(t), "1 day", _lateness(t)))
    return done.where("event_type != 'end'").select(F.to_date("start").alias("day"), "event_type", "n", "total", "mean")


@query("STR04_sliding_windows", "SELECT CAST(d AS DATE) AS day, event_type, count(*) AS n, sum(value) AS total FROM (SELECT time_bucket(INTERVAL '1 day', ts) - k * INTERVAL '1 day' AS d, event_type, value FROM events, range(0, 3) r(k)) GROUP BY 1, 2", "total", "n", digits=6)
def _(t: Tables) -> DataFrame:
    done = _finished(t, E.sliding(_events(t), "3 days", "1 day", _lateness(t)))
    return done.where("event_type != 'end'").select(F.to_date("start").alias("day"), "event_type", "n", "total")


@query("STR02_sequential_state", "SELECT user_id, count(*) AS n, product(1 + coalesce(value, 0) * 1e-4) AS wealth FROM events GROUP BY 1", "wealth", "n")
def _(t: Tables) -> DataFrame:
    out, marks = work_dir(t.spark), work_dir(t.spark)
    stream = E.running_wealth(_events(t))
    q = stream.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).option("checkpointLocation", marks).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    done = t.spark.read.schema(stream.schema).parquet(out).where("user_id IS NOT NULL")
    return done.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("wealth", "n").alias("wealth"))


def days(t: Tables, bps: float = 5.0) -> DataFrame:
    """The days of the books made by rule from their first decision on, one row a strategy
    and day, as ``portfolio.DAYS``."""
    start = t.sched.agg(F.min("as_of").alias("start"))
    rows = t.panel.join(F.broadcast(start), F.col("date") >= F.col("start"))  # start is one row
    byday = rows.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("asset", "ret"))).alias("x"))
    byday = byday.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)  # a row a date
    books = _books(t)
    target = books.groupBy("strategy", F.col("as_of").alias("date")).agg(F.map_from_entries(F.collect_list(F.struct("asset", "weight"))).alias("w"))
    each = byday.withColumn("strategy", F.explode(F.array(*[F.lit(r[0]) for r in books.select("strategy").distinct().collect()])))
    met = each.join(target, ["strategy", "date"], "left")
    weights = F.when(F.col("w").isNotNull(), F.transform("x", lambda v: F.element_at("w", v["asset"])))
    return met.select("strategy", F.col("pos").cast("long").alias("pos"), "date", F.col("x.asset").alias("assets"), F.col("x.ret").alias("rets"), weights.alias("weights"), F.transform("x", lambda v: F.lit(bps / 10000.0)).alias("rates"))


def run_ledger(t: Tables, folder: str, out: str, marks: str, files_per_batch: int) -> DataFrame:
    """Run the days' files that are there through the state and return the whole ledger."""
    name, kind = portfolio.PROVIDER
    before = t.spark.conf.get(name, None)
    t.spark.conf.set(name, kind)
    try:
        stream = portfolio.ledger(portfolio.read_days(t.spark, folder, files_per_batch))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        t.spark.conf.unset(name) if before is None else t.spark.conf.set(name, before)
    return t.spark.read.schema(stream.schema).parquet(out)


_LEDGER = """, lg AS (SELECT p.strategy, p.date, coalesce(lag(net_wealth) OVER w, 1.0) AS start_nav, net_wealth / (1 - transaction_cost) AS pre_trade_nav, net_wealth / (1 - transaction_cost) * transaction_cost AS cost, net_wealth AS end_nav, max(net_wealth) OVER w AS peak, s.as_of IS NOT NULL AS executed
  FROM path p LEFT JOIN sched s ON s.as_of = p.date WHERE cost_bps = 5 WINDOW w AS (PARTITION BY p.strategy ORDER BY p.date)),
fl AS (SELECT *, 0.0 AS cash, end_nav / peak - 1 AS drawdown, min(end_nav / peak - 1) OVER (PARTITION BY strategy ORDER BY date) AS worst FROM lg)"""


@query("STR02_portfolio_state", _BOOKS + _PATHS + _LEDGER + " FINAL SELECT strategy, date, start_nav, pre_trade_nav, cost, end_nav, cash, peak, drawdown, worst, executed FROM fl", "start_nav pre_trade_nav cost end_nav cash peak drawdown worst")
def _(t: Tables) -> DataFrame:
    """Holdings, cash and wealth of every book, a day at a time over several triggers."""
    folder = work_dir(t.spark)
    rows = days(t)
    _in_order(rows, "date", folder, _cuts(rows, "date"))
    return run_ledger(t, folder, work_dir(t.spark), work_dir(t.spark), 4).drop("pos")


@query("STR01_information_boundary", "SELECT s.as_of, p.asset, p.date, p.ret FROM sched s JOIN panel p ON p.date < s.as_of AND p.date >= s.as_of - INTERVAL 364 DAY", "ret")
def _(t: Tables) -> DataFrame:
    """What each decision may know: decisions and returns as streams, joined in time."""
    done = _finished(t, boundary.visible(*boundary_streams(t, 4)))
    return done.select(F.to_date("as_of").alias("as_of"), "asset", F.to_date("date").alias("date"), "ret")


def boundary_streams(t: Tables, files_per_batch: int, back: int = 364) -> tuple[DataFrame, DataFrame, int, str]:
    """Decisions, returns, days back and lateness of ``boundary.visible``."""
    returns = t.panel.select(F.col("date").cast("timestamp").alias("date"), "asset", "ret")
    asked = t.win.select(F.col("as_of").cast("timestamp").alias("as_of"), "asset").distinct()
    cuts = _cuts(returns, "date")
    streams = []
    for rows, column in ((asked, "as_of"), (returns, "date")):
        folder = work_dir(t.spark)
        _in_order(rows, column, folder, cuts)
        streams.append(t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    return (*streams, back, _late(cuts))
