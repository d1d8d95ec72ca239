"""Policies as table functions, and the registry of what a run stored."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import policies

D = [dt.date(2024, 1, 1), dt.date(2024, 4, 1), dt.date(2024, 7, 1)]


@pytest.fixture(scope="module")
def windows(spark):
    rows = [(d, k, a, None if (k, a) == (1, "B") else float(k) if a == "A" else -1.0) for d in D for k in range(3) for a in ("A", "B")]
    return spark.createDataFrame(rows, "as_of date, k int, asset string, ret double").repartition(3)


def test_windows_come_in_order_and_rules_are_kept(windows):
    seen = lambda w: {"A": 1.0} if w == {"A": [0.0, 1.0, 2.0], "B": [-1.0, -1.0]} else {}
    cases = {
        "fine": seen, "half": lambda w: {"A": 0.5, "B": 0.5 + 1e-8}, "over": lambda w: {"A": 0.95, "B": 0.05}, "short": lambda w: {"A": -0.1, "B": 0.8, "C": 0.3},
        "odd": lambda w: {"A": float("nan"), "B": None}, "none": lambda w: {}, "fails": lambda w: 1 / 0,
    }
    got = policies.decisions(windows, cases, cap=0.9).collect()
    said = {n: sorted({(r.asset, r.weight, r.fault) for r in got if r.strategy == n}, key=str) for n in cases}
    assert said["fine"] == [("A", None, "ABOVE_CAP")] and said["half"] == [("A", 0.5, None), ("B", 0.5 + 1e-8, None)]
    assert said["over"] == [("A", None, "ABOVE_CAP")]
    assert said["short"] == [("A", None, "SHORT"), ("C", None, "UNKNOWN_ASSET")]
    assert said["odd"] == [("A", None, "NOT_FINITE"), ("B", None, "NOT_FINITE"), (None, None, "SUM")]
    assert said["none"] == [(None, None, "SUM")] and said["fails"] == [(None, None, "RAISED ZeroDivisionError")]
    assert all({r.as_of for r in got if r.strategy == n} == set(D) for n in cases)


def test_a_policy_names_the_columns_it_lacks(spark, windows):
    policies.register(spark, "policy_of_test", lambda w: {})
    windows.drop("ret").createOrReplaceTempView("lacking")
    with pytest.raises(Exception, match="ret"):
        spark.sql("SELECT * FROM policy_of_test(TABLE(lacking))").collect()
    assert policies.decisions(windows.limit(0), {"none": lambda w: {}}).count() == 0


def test_the_registry_follows_what_is_stored(spark):
    schedule = spark.createDataFrame([(d,) for d in D], "as_of date")
    books = spark.createDataFrame([(s, d, a, 0.5) for s, n in (("one", 3), ("two", 2)) for d in D[:n] for a in "AB"], "strategy string, as_of date, asset string, weight double")
    failures = spark.createDataFrame([("two", D[2]), ("three", D[0]), ("three", D[0])], "strategy string, as_of date")
    rows = {r.strategy: tuple(r)[1:] for r in policies.registry(books, failures, schedule).collect()}
    assert rows == {"one": (3, D[0], D[2], 0, "COMPLETE"), "two": (2, D[0], D[1], 1, "FAILED_EXPLICITLY"), "three": (0, None, None, 1, "FAILED_EXPLICITLY")}
    fewer = books.where(~((F.col("strategy") == "one") & (F.col("as_of") == D[1])))
    again = {r.strategy: r.status for r in policies.registry(fewer, failures, schedule).collect()}
    assert again["one"] == "FAILED_EXPLICITLY"
