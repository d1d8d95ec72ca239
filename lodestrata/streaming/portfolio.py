"""A portfolio's own state, day by day, on a stream.

A day of a strategy is one row: its place in the calendar, the assets' returns and, at a
decision, the target weights. What is held drifts by the day's returns first; a target is
then traded at the close, where the wealth after costs solves its fixed point with a rate
for every asset. Days may come in any order and in any number of triggers: one that comes
before its turn waits in the state, so a day is applied once, after the one before it. The
state is what a run needs to go on after a restart.

Cases: a day without a target trades nothing; a null return is none; assets that leave are
sold at the next target, held at no return until then; a day that was applied before is
ignored; null weights count as zero.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.operators.backtest import STEPS

DAYS = "strategy string, pos long, date date, assets array<string>, rets array<double>, weights array<double>, rates array<double>"
LEDGER = "strategy string, pos long, date date, start_nav double, pre_trade_nav double, cost double, end_nav double, cash double, peak double, drawdown double, worst double, executed boolean"
BOOK = "next long, cash double, nav double, peak double, worst double, assets array<string>, holdings array<double>"

#: State in RocksDB on the executors, its changes in the checkpoint.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def traded(nav: float, held: dict[str, float], weights: dict[str, float], rates: dict[str, float]) -> float:
    """Wealth after a trade from held amounts to weights: n = nav - sum rate |w n - held|."""
    after, names = nav, held.keys() | weights.keys()
    for _ in range(STEPS):
        after = nav - sum(rates.get(a, 0.0) * abs(weights.get(a, 0.0) * after - held.get(a, 0.0)) for a in sorted(names))
    return after


class Portfolio(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getValueState("book", BOOK)
        self.waiting = handle.getMapState("waiting", "pos long", "date date, assets array<string>, rets array<double>, weights array<double>, rates array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        book = self.book.get() if self.book.exists() else None
        following, cash, nav, peak, worst = tuple(book)[:5] if book else (0, 1.0, 1.0, 0.0, 0.0)
        held = dict(zip(book[5], book[6], strict=True)) if book else {}
        for row in rows:
            day = (row.date, row.assets, row.rets, row.weights, row.rates)
            if row.pos > following:
                self.waiting.updateValue((row.pos,), day)
            while day is not None and row.pos <= following:
                if row.pos < following and day[0] == row.date:
                    break  # it was applied before
                start, cash, held, cost = nav, *self._apply(day, cash, held)
                nav = cash + sum(held.values())
                peak = max(peak, nav)
                worst = min(worst, nav / peak - 1)
                yield Row(strategy=key[0], pos=following, date=day[0], start_nav=start, pre_trade_nav=nav + cost, cost=cost, end_nav=nav, cash=cash, peak=peak, drawdown=nav / peak - 1, worst=worst, executed=day[3] is not None)
                following += 1
                day = self._waited(following)
        self.book.update((following, cash, nav, peak, worst, list(held), list(held.values())))

    def _waited(self, pos: int) -> tuple | None:
        if not self.waiting.containsKey((pos,)):
            return None
        day = tuple(self.waiting.getValue((pos,)))
        self.waiting.removeKey((pos,))
        return day

    @staticmethod
    def _apply(day: tuple, cash: float, held: dict[str, float]) -> tuple[float, dict[str, float], float]:
        _, assets, rets, weights, rates = day
        moved = dict(zip(assets, rets, strict=True))
        held = {a: v * (1 + (moved.get(a) or 0.0)) for a, v in held.items()}
        if weights is None:
            return cash, held, 0.0
        target = {a: w for a, w in zip(assets, weights, strict=True) if w}
        nav = cash + sum(held.values())
        after = traded(nav, held, target, {a: r or 0.0 for a, r in zip(assets, rates, strict=True)})
        held = {a: w * after for a, w in target.items()}
        return after - sum(held.values()), held, nav - after

    def close(self) -> None:
        pass


def ledger(days: DataFrame) -> DataFrame:
    """A stream of days -> one row a day: the ledger with cash, peak and drawdowns."""
    return days.groupBy("strategy").transformWithState(Portfolio(), LEDGER, "Append", "None")


def read_days(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(DAYS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
