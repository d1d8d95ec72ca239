"""Registered queries against their SQL in another engine."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry

SOME = ["SRC01_wide_csv_scan", "PRJ08_clean_returns", "PRJ10_quarter_schedule", "PRJ23_point_in_time_snapshot", "JN10_asof_join", "AGG05_interpolated_quantile", "EST06_cov_ewma", "EST07_cov_iewma", "EST09_cov_ledoit_wolf", "OPT03_inverse_volatility", "flagship_backtest", "INF03_intervals", "INF05_deflated_sharpe", "CLU01_correlation_distance", "REG01_regimes", "WIN03_expanding_median", "JN15_pair_join", "STR03_tumbling_windows", "OPT11_clean_weights", "OPT16_inner_problems", "EST08_iewma_diagonal_batch", "UDF02_cost_models", "UDF03_execution_clock", "SRC14_validated_artifacts", "BT03_asset_cost_rates", "BT03_refused_rates", "BT04_cost_factory", "BT05_target_validation", "BT08_state_invariants", "BT08_refused_states", "BT09_clock_returns", "JN03_join_on_strategy", "JN06_lookup_by_date_and_model", "JN12_scenario_grid", "OPT12_faulty_covariances", "PRJ19_found_by_guard", "FN01_math", "FN04_dates", "FN05_arrays_and_maps", "FN06_canonical_json", "FN08_normal_distribution", "EST19_covariance_methods", "BT06_asset_rate_factor", "INF01_index_matrix", "EST12_block_bootstrap_indices", "OPT20_stored_registry", "OPT16_solved_inner_problems", "UDF01_policy_functions", "SNK06_published_outputs", "STR01_information_boundary"]


def norm(v):
    if v is None or v != v:
        return "None"
    return str(v.date()) if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(norm, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(norm, r)) for r in want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_grid_of_strategies_and_costs(spark, sf_dir):
    """27 strategies at five costs, less those that lack a decision; rule-made books fare as in the flagship."""
    from lodestrata.plans.base import Tables
    from lodestrata.plans.rules import grid_books

    books, lacking = grid_books(Tables(spark, sf_dir))
    names = {r.strategy for r in books.select("strategy").union(lacking).distinct().collect()}
    assert len(names) == 27
    grid = entry.queries()["BT14_strategy_cost_grid"](spark, sf_dir).collect()
    assert len(grid) == 5 * (27 - lacking.count())
    known = {(r.strategy, r.cost_bps): r for r in grid}
    for r in entry.queries()["flagship_backtest"](spark, sf_dir).collect():
        other = known[r.strategy, r.cost_bps]
        assert other.days == r.days and other.final_net_wealth == pytest.approx(r.final_net_wealth, abs=2e-5)
