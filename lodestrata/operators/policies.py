"""Target policies as table functions: what a user plugs in, and what is asked of it.

A policy is a function from a decision's window, the returns of each asset in order of
time, to weights. ``register`` makes it a table function of SQL; its table argument is
dealt by date and ordered inside, and its output is declared and checked: weights of known
assets, within their bounds, that add up to one. A policy that breaks a rule gives no
weights for that date but a row for each fault, and so does one that raises.

Cases: a window without rows is no decision; a null return is left out of an asset's list;
a weight that is null or not finite is a fault of its asset; a policy may leave assets out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DateType, DoubleType, StringType, StructType

Policy = Callable[[dict[str, list[float]]], dict[str, float]]

#: How far weights may miss their bounds and their sum.
TOLERANCE = 5e-7

OUTPUT = StructType().add("as_of", DateType()).add("asset", StringType()).add("weight", DoubleType()).add("fault", StringType())


def faults(weights: dict[str, float | None], known: set[str], cap: float) -> list[tuple[str | None, str]]:
    """What is wrong with weights: (asset or null, fault)."""
    bad: list[tuple[str | None, str]] = []
    for asset in sorted(weights):
        w = weights[asset]
        if asset not in known:
            bad.append((asset, "UNKNOWN_ASSET"))
        if w is None or not math.isfinite(w):
            bad.append((asset, "NOT_FINITE"))
        elif w < -TOLERANCE:
            bad.append((asset, "SHORT"))
        elif w > cap + TOLERANCE:
            bad.append((asset, "ABOVE_CAP"))
    total = math.fsum(w for w in weights.values() if w is not None and math.isfinite(w))
    if abs(total - 1) > TOLERANCE:
        bad.append((None, "SUM"))
    return bad


def table_function(policy: Policy, cap: float = 1.0):
    """The policy as a Python table function over as_of, k, asset, ret."""

    class Decisions:
        def __init__(self):
            self.as_of, self.seen = None, {}

        @staticmethod
        def analyze(window: AnalyzeArgument) -> AnalyzeResult:
            have = set(window.dataType.fieldNames()) if window.isTable else set()
            if lacking := {"as_of", "k", "asset", "ret"} - have:
                raise ValueError(f"a policy reads a table with {sorted(lacking)}")
            return AnalyzeResult(schema=OUTPUT, partitionBy=[PartitioningColumn("as_of")], orderBy=[OrderingColumn("k"), OrderingColumn("asset")])

        def eval(self, row) -> None:
            self.as_of = row["as_of"]
            series = self.seen.setdefault(row["asset"], [])
            if row["ret"] is not None:
                series.append(row["ret"])

        def terminate(self) -> Iterator[tuple]:
            if not self.seen:
                return
            try:
                weights = policy({a: list(r) for a, r in self.seen.items()})
                bad = faults(weights, set(self.seen), cap)
            except Exception as e:  # noqa: BLE001  a policy's own failure is a fault of its date
                weights, bad = {}, [(None, f"RAISED {type(e).__name__}")]
            if bad:
                yield from ((self.as_of, asset, None, fault) for asset, fault in bad)
            else:
                yield from ((self.as_of, a, float(w), None) for a, w in sorted(weights.items()))

    return udtf(Decisions)


def register(spark: SparkSession, name: str, policy: Policy, cap: float = 1.0) -> None:
    """From now on ``SELECT * FROM name(TABLE(..))`` gives the policy's decisions."""
    spark.udtf.register(name, table_function(policy, cap))


def decisions(windows: DataFrame, policies: dict[str, Policy], cap: float = 1.0) -> DataFrame:
    """strategy, as_of, asset, weight, fault of every policy over the windows."""
    spark, out = windows.sparkSession, None
    windows.select("as_of", "k", "asset", "ret").createOrReplaceTempView("policy_windows")
    for name, policy in policies.items():
        register(spark, f"policy_{name}", policy, cap)
        one = spark.sql(f"SELECT * FROM policy_{name}(TABLE(policy_windows))").select(F.lit(name).alias("strategy"), *OUTPUT.names)
        out = one if out is None else out.unionByName(one)
    return out


def registry(books: DataFrame, failures: DataFrame, schedule: DataFrame) -> DataFrame:
    """What a run has: strategy, decisions, first and last of them, failures, and whether it
    is complete, as stored. books: strategy, as_of, asset, weight; failures: strategy, as_of."""
    need = schedule.agg(F.count("*").alias("need"))
    have = books.where("weight IS NOT NULL").groupBy("strategy").agg(F.count_distinct("as_of").alias("decisions"), F.min("as_of").alias("first"), F.max("as_of").alias("last"))
    lost = failures.groupBy("strategy").agg(F.count_distinct("as_of").alias("failures"))
    met = have.join(lost, "strategy", "full").join(F.broadcast(need))  # need is one row
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("decisions", "failures")}
    met = met.withColumns(zero)
    status = F.when((F.col("decisions") == F.col("need")) & (F.col("failures") == 0), "COMPLETE").otherwise("FAILED_EXPLICITLY")
    return met.select("strategy", "decisions", "first", "last", "failures", status.alias("status"))
