"""Resamples draw from every row of the series, whatever its length."""

import duckdb
import numpy as np
import pytest
from test_queries import norm

import __spark_entry__ as entry
from lodestrata.operators.estimators import correlation
from lodestrata.operators.gram import cells
from lodestrata.plans.base import Tables

WHOLE = ["INF02_replicates", "INF03_intervals", "INF04_paired_intervals", "INF06_inference_driver", "SNK04_index_matrix"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf_dir}/part.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(norm, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(norm, r)) for r in want)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_every_draw_has_as_many_positions_as_the_series(spark, sf_dir, size):
    folder = sf_dir.replace("sf0.001", size)
    panel = Tables(spark, folder).panel
    weeks, strategies = panel.select("date").distinct().count(), panel.select("asset").distinct().count()
    matrix = entry.queries()["SNK04_index_matrix"](spark, folder).collect()
    assert {r.positions for r in matrix} == {weeks} and len(matrix) == 100 * strategies
    stationary = entry.queries()["INF01_stationary_indices"](spark, folder).collect()
    assert {r.positions for r in stationary} == {weeks} and len(stationary) == 100 * strategies


def test_expanding_median_by_hand(spark):
    """Unordered rows, a tie, an asset of one row, an empty panel."""
    from datetime import date

    from lodestrata.operators.regimes import expanding_median

    rows = [(date(2020, 1, d), "A", r) for d, r in ((3, 0.1), (1, 0.3), (4, 0.5), (2, 0.1))] + [(date(2020, 1, 2), "B", 0.7)]
    panel = spark.createDataFrame(rows, "date date, asset string, ret double")
    got = {(r.asset, r.date.day): r.med for r in expanding_median(panel).collect()}
    assert got == {("A", 1): None, ("A", 2): 0.3, ("A", 3): 0.2, ("A", 4): 0.1, ("B", 2): None}
    assert expanding_median(panel.limit(0)).count() == 0


def test_pairs_are_mirrored(spark):
    """Each pair of assets is met once and reported in both orders."""
    from lodestrata.operators.gram import cells, mirrored

    rows = spark.createDataFrame([("d", k, a, float(k + len(a))) for k in range(3) for a in ("A", "BB", "CCC")], "as_of string, k int, asset string, ret double")
    half = cells(rows)
    assert half.count() == 6
    both = mirrored(half)
    assert both.count() == 9 == both.select("asset_i", "asset_j").distinct().count()


def test_blocked_pairs_equal_a_plain_join(spark):
    """Several blocks, chunks, weights, missing rows and nulls against the join of all pairs."""
    rng = np.random.default_rng(6)
    data = [(d, int(k), f"A{a:02d}", None if rng.random() < 0.1 else float(rng.normal())) for d in ("x", "y") for a in range(23) for k in (*range(12), *range(1020, 1030), 5000) if rng.random() < 0.8]
    rows = spark.createDataFrame(data, "as_of string, k int, asset string, ret double")
    b = 0.999
    got = {(r.as_of, r.asset_i, r.asset_j): r for r in cells(rows, decay=(b, 5000), block=5).collect()}
    want: dict = {}
    by = {}
    for d, k, a, v in data:
        if v is not None:
            by.setdefault((d, k), []).append((a, v))
    for (d, k), seen in by.items():
        for i, x in seen:
            for j, y in seen:
                if i <= j:
                    w = b ** (5000 - k)
                    one = want.setdefault((d, i, j), np.zeros(7))
                    one += np.array([1, w, w * x, w * y, w * x * y, w * x * x, w * y * y])
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert [r.n, r.w, r.x, r.y, r.xy, r.xx, r.yy] == pytest.approx(want[key].tolist(), abs=1e-12)
    assert cells(rows.limit(0)).count() == 0


def test_what_does_not_vary_has_no_correlation(spark):
    rows = spark.createDataFrame([(1, k, a, v) for k in range(9) for a, v in (("A", 0.1), ("B", float(k)), ("C", -2.0 * k))], "as_of int, k int, asset string, ret double")
    rho = {(r.asset_i, r.asset_j): r.rho for r in correlation(rows, 9).collect()}
    assert rho["A", "B"] is None and rho["A", "A"] is None and rho["B", "C"] == -1.0 and rho["C", "C"] == 1.0
