"""A portfolio's state over triggers and restarts; the boundary of decisions on streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import streams as S
from lodestrata.plans.base import Tables
from lodestrata.streaming import boundary, portfolio

DAY = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(60)]


def day_rows() -> list[tuple]:
    rng = random.Random(4)
    rows = []
    for s in ("one", "two"):
        for i in range(12):
            target = [rng.choice([0.3, 0.6]), None, 0.4] if i % 4 == 0 else None
            rows.append((s, i, DAY[i], ["A", "B", "C"], [rng.uniform(-0.05, 0.05), None, 0.01], target, [0.001, 0.0, 0.02]))
    return rows


def by_hand(rows: list[tuple]) -> list[tuple]:
    out = []
    for s in ("one", "two"):
        cash, held, peak, worst = 1.0, [0.0] * 3, 0.0, 0.0
        start = 1.0
        for _, pos, date, _, rets, target, rates in sorted(r for r in rows if r[0] == s):
            held = [h * (1 + (r or 0)) for h, r in zip(held, rets, strict=True)]
            nav, cost = cash + sum(held), 0.0
            if target:
                w = [x or 0.0 for x in target]
                lo, hi = 0.0, nav
                for _ in range(80):  # the wealth after costs by bisection
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if mid + sum(c * abs(x * mid - h) for c, x, h in zip(rates, w, held, strict=True)) < nav else (lo, mid)
                cost, held = nav - lo, [x * lo for x in w]
                cash = lo - sum(held)
            end = cash + sum(held)
            peak = max(peak, end)
            worst = min(worst, end / peak - 1)
            out.append((s, pos, date, start, nav, cost, end, cash, peak, end / peak - 1, worst, target is not None))
            start = end
    return out


def same(got: list, want: list[tuple]) -> None:
    got = sorted(tuple(r) for r in got)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[-1] == b[-1] and a[3:-1] == pytest.approx(b[3:-1], abs=1e-12)


def test_days_in_any_order_triggers_and_a_restart(spark, tmp_path):
    rows, t = day_rows(), Tables(spark, "")
    df = spark.createDataFrame(rows, portfolio.DAYS)
    later = df.where("pos % 3 = 0")  # the first day comes with the second run
    folder, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    df.where("pos % 3 != 0").repartition(2, "pos").write.parquet(folder)
    assert S.run_ledger(t, folder, out, marks, 1).count() == 0
    later.coalesce(1).write.mode("append").parquet(folder)
    df.where("pos = 5").coalesce(1).write.mode("append").parquet(folder)  # days that were applied before
    same(S.run_ledger(t, folder, out, marks, 1).collect(), by_hand(rows))
    at_once = S.run_ledger(t, folder, str(tmp_path / "out2"), str(tmp_path / "marks2"), 1000)
    same(at_once.collect(), by_hand(rows))


def test_nothing_at_or_after_a_decision_is_visible(spark, tmp_path):
    returns = spark.createDataFrame([(dt.datetime.combine(d, dt.time()), a, float(i)) for i, d in enumerate(DAY) for a in "AB"], "date timestamp, asset string, ret double")
    asked = spark.createDataFrame([(dt.datetime.combine(DAY[i], dt.time()), a) for i in range(0, 60, 5) for a in "AB"], "as_of timestamp, asset string")
    cuts = S._cuts(returns, "date")
    for name, rows, column in (("asked", asked, "as_of"), ("returns", returns, "date")):
        S._in_order(rows.coalesce(1), column, str(tmp_path / name), cuts)
    read = lambda n, rows: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    joined = boundary.visible(read("asked", asked), read("returns", returns), 35, S._late(cuts))
    q = joined.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("seen").select("as_of", "asset", "date").collect()))
    want = asked.alias("d").join(returns.alias("r"), F.expr("d.asset = r.asset AND r.date < d.as_of AND r.date >= d.as_of - INTERVAL 35 DAYS")).select("as_of", "d.asset", "date").collect()
    assert got == sorted(map(tuple, want)) and all(date < as_of for as_of, _, date in got)
    kept = [op.numRowsTotal for p in q.recentProgress for op in p.stateOperators]
    assert max(kept) < 0.8 * (returns.count() + asked.count()) and kept[-1] < 60  # what can meet no more leaves


def test_paths_without_state_equal_the_state_machine(spark):
    """Wealth from products of period factors against days one after another."""
    from lodestrata.operators import backtest

    rng = random.Random(12)
    panel = [(d, a, rng.gauss(0.001, 0.03)) for d in DAY for a in "ABCDE"]
    at = [5, 13, 14, 30, 52]
    sched = spark.createDataFrame([(DAY[p], p, DAY[q] if q else None) for p, q in zip(at, [*at[1:], None], strict=True)], "as_of date, pos int, next_as_of date")
    books, rates = {}, {a: rng.uniform(0, 0.02) for a in "ABCDE"}
    for s in ("one", "two", "three"):
        for p in at:
            w = [rng.random() if rng.random() < 0.7 else 0.0 for _ in "ABCDE"]
            w[0] += 0.1
            books[s, p] = [x / sum(w) for x in w]
    weights = spark.createDataFrame([(s, DAY[p], a, x) for (s, p), w in books.items() for a, x in zip("ABCDE", w, strict=True)], "strategy string, as_of date, asset string, weight double")
    bps = spark.createDataFrame([("own", a, 10000 * r) for a, r in rates.items()], "scenario string, asset string, bps double")
    got = {(r.strategy, r.date): r.net_wealth for r in backtest.asset_rate_wealth(weights, spark.createDataFrame(panel, "date date, asset string, ret double"), sched, bps).collect()}
    assert len(got) == 3 * (60 - 5)
    for s in ("one", "two", "three"):
        cash, held = 1.0, {}
        for i, d in enumerate(DAY[5:], 5):
            day = (d, list("ABCDE"), [r for e, _, r in panel if e == d], books.get((s, i)), [rates[a] for a in "ABCDE"])
            cash, held, _ = portfolio.Portfolio._apply(day, cash, held)
            assert got[s, d] == pytest.approx(cash + sum(held.values()), abs=1e-12)
