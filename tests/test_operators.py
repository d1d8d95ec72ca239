"""Hand-calculated cases and properties of the panel engine. Numbers in the assertions are
fixed values: worked out by hand, or what the definitions give."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import stats
from lodestrata.operators import asof, backtest, cleaning, estimators, kernels, portfolio, regimes, resampling
from lodestrata.sources import panels

D = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(800)]


def panel(spark, columns):
    """columns: asset -> returns from D[0] on."""
    rows = [(D[i], a, float(r)) for a, rs in columns.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "date date, asset string, ret double")


def schedule(spark, places):
    rows = [(D[p], p, D[q] if q is not None else None) for p, q in zip(places, [*places[1:], None])]
    return spark.createDataFrame(rows, "as_of date, pos int, next_as_of date")


def book(spark, rows):
    return spark.createDataFrame([("s", D[p], a, float(w)) for p, a, w in rows], "strategy string, as_of date, asset string, weight double")


def paths(spark, cols, weights, places, bps):
    p = backtest.wealth(book(spark, weights), panel(spark, cols), schedule(spark, places), spark.createDataFrame([(float(b),) for b in bps], "cost_bps double"))
    return {(r.cost_bps, r.date): r for r in p.collect()}


def test_drift_is_not_reset_daily(spark):
    got = paths(spark, {"A": [0, 0.1, 0.1], "B": [0, 0, 0]}, [(0, "A", 0.5), (0, "B", 0.5)], [0], [0])
    assert got[(0.0, D[1])].net_wealth == pytest.approx(1.05)
    assert got[(0.0, D[2])].net_wealth == pytest.approx(0.5 * 1.1**2 + 0.5)


def test_execution_timing(spark):
    got = paths(spark, {"A": [0, 0.5, 1, 0], "B": [0, 0, 0, 0.1]}, [(1, "A", 1), (2, "B", 1)], [1, 2], [0])
    assert [got[(0.0, D[i])].gross_wealth for i in (1, 2, 3)] == pytest.approx([1.0, 2.0, 2.2])


def test_linear_costs_are_exact(spark):
    execs = spark.createDataFrame([("s", D[0], "A", 1.0, 0.5), ("s", D[0], "B", 0.0, 0.5)], "strategy string, as_of date, asset string, weight double, drifted double")
    phi = backtest.cost_factors(execs, spark.createDataFrame([(100.0,), (0.0,)], "cost_bps double")).collect()
    got = {r.cost_bps: r.phi for r in phi}
    # selling half and buying half at 1%: V + c(|V - .5| + .5) = 1
    assert got[0.0] == 1.0 and got[100.0] == pytest.approx((1 - 0.01 * 0.5 + 0.01 * 0.5) / 1.01, abs=1e-12)


def test_cost_factor_against_bisection(spark):
    rng = np.random.default_rng(0)
    w, u = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6))
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid + 0.0025 * np.abs(w * mid - u).sum() < 1 else (lo, mid)
    row = spark.range(1).select(backtest.cost_factor(F.array(*map(F.lit, w.tolist())), F.array(*map(F.lit, u.tolist())), F.lit(0.0025)).alias("phi")).first()
    assert row.phi == pytest.approx(lo, abs=1e-12)


def test_net_path_against_sequential_simulation(spark):
    rng = np.random.default_rng(1)
    n, places, c = 40, [5, 15, 27], 0.001
    cols = {a: rng.normal(0, 0.02, n) for a in "ABC"}
    targets = {p: rng.dirichlet(np.ones(3)) for p in places}
    got = paths(spark, cols, [(p, a, w) for p in places for a, w in zip("ABC", targets[p])], places, [10])
    nav, held, want = 1.0, np.zeros(3), {}
    for i in range(places[0], n):
        if held.sum():
            held = held * (1 + np.array([cols[a][i] for a in "ABC"]))
            nav = held.sum()
        if i in targets:
            lo, hi = 0.0, nav
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if mid + c * np.abs(targets[i] * mid - held).sum() < nav else (lo, mid)
            nav, held = lo, targets[i] * lo
        want[D[i]] = nav
    assert {d: r.net_wealth for (_, d), r in got.items()} == pytest.approx(want, abs=1e-12)


def test_asof_windows_never_see_the_date_or_later(spark):
    base = panel(spark, {"A": range(10), "B": range(10)})
    s = schedule(spark, [4, 8])
    later = base.withColumn("ret", F.when(F.col("date") >= D[8], 99.0).otherwise(F.col("ret")))
    a, b = (sorted(map(tuple, asof.training_windows(x, s, 3).collect())) for x in (base, later))
    assert a == b and {r[2] for r in a if r[0] == D[4]} == {D[1], D[2], D[3]}
    with pytest.raises(KeyError):
        asof.before(base, "2020-01-05", ["Z"])


def test_snapshots(spark):
    p = panel(spark, {"A": [0] * 6}).unionByName(panel(spark, {"B": [0] * 6}).where(F.col("date") >= D[2]))
    li = spark.createDataFrame([("A", D[0] - dt.timedelta(days=1), None), ("B", D[2], D[5])], "asset string, listing_date date, inactive_date date")
    got = {(r.as_of, r.asset): r.reason for r in asof.point_in_time_snapshot(p, li, schedule(spark, [2, 3, 4, 5]), 2).collect()}
    assert [got[(D[i], "B")] for i in (2, 3, 4, 5)] == ["NOT_LISTED", "INSUFFICIENT_HISTORY", None, "INACTIVE"]
    assert {got[(D[i], "A")] for i in (2, 3, 4, 5)} == {None}


def test_fill_limit_and_cleaning(spark):
    px = [(D[i], "A", 1.0 + i) for i in range(30)] + [(D[i], "B", 2.0) for i in range(30) if i not in (10, 11)] + [(D[i], "C", 3.0) for i in range(5)]
    prices = spark.createDataFrame(px, "date date, asset string, px double")
    filled = {(r.date, r.asset): r.px for r in cleaning.forward_fill(cleaning.grid(prices), 5).collect()}
    assert filled[(D[9], "C")] == 3.0 and filled[(D[10], "C")] is None and filled[(D[11], "B")] == 2.0
    assert {r.asset for r in cleaning.clean(prices).select("asset").distinct().collect()} == {"A", "B"}


def windows(spark, x, names="ABCDEFGH"):
    return spark.createDataFrame([(D[700], k, names[j], float(x[k, j])) for k in range(x.shape[0]) for j in range(x.shape[1])], "as_of date, k int, asset string, ret double")


def matrix(df, n):
    out = np.empty((n, n))
    for r in df.collect():
        out["ABCDEFGH".index(r.asset_i), "ABCDEFGH".index(r.asset_j)] = r.cov
    return out


def test_covariances_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.01, (40, 4))
    w = windows(spark, x)
    assert matrix(estimators.cov_sample(w, 1), 4) == pytest.approx(np.cov(x.T))
    q = 2.0 ** (-(39 - np.arange(40)) / 10)
    q /= q.sum()
    m = q @ x
    assert matrix(estimators.cov_ewma(w, 40, 1, 10), 4) == pytest.approx((x - m).T @ ((x - m) * q[:, None]))
    bv, bc = 2 ** (-1 / 10), 2 ** (-1 / 20)
    v, c = np.maximum(x[0] ** 2, 1e-14), np.eye(4)
    for k in range(1, 40):
        z = np.clip(x[k] / np.sqrt(v), -4.2, 4.2)
        c = bc * c + (1 - bc) * np.outer(z, z)
        v = bv * v + (1 - bv) * x[k] ** 2
    d = np.sqrt(np.diag(c))
    assert matrix(estimators.cov_iewma(w, 40, 1, 10, 20), 4) == pytest.approx(c / np.outer(d, d) * np.sqrt(np.outer(v, v)))
    lw = estimators.cov_ledoit_wolf(w, 40, 1)
    shrink = lw.first().shrinkage
    assert 0 <= shrink <= 1 and np.linalg.eigvalsh(matrix(lw, 4))[0] > 0


def test_capped_weights(spark):
    s = spark.createDataFrame([(D[0], a, v) for a, v in (("A", 100.0), ("B", 50.0), ("C", 1.0), ("D", 1.0), ("E", 1.0))], "as_of date, asset string, score double")
    got = {r.asset: r.weight for r in portfolio.capped_proportional(s, 0.35).collect()}
    assert got == pytest.approx({"A": 0.35, "B": 0.35, "C": 0.1, "D": 0.1, "E": 0.1})
    with pytest.raises(Exception, match="cap times assets"):
        portfolio.capped_proportional(s, 0.1).collect()
    v = spark.createDataFrame([(D[0], "A", 0.2), (D[0], "B", 0.1)], "as_of date, asset string, vol double")
    assert {r.asset: r.weight for r in portfolio.inverse_volatility(v, 1.0).collect()} == pytest.approx({"A": 1 / 3, "B": 2 / 3})


def test_class_weights_and_clones(spark):
    a = spark.createDataFrame([(D[0], x) for x in "ABC"], "as_of date, asset string")
    cls = spark.createDataFrame([("A", "e"), ("B", "e"), ("C", "b")], "asset string, asset_class string")
    assert {r.asset: r.weight for r in portfolio.class_equal_weight(a, cls).collect()} == pytest.approx({"A": 0.25, "B": 0.25, "C": 0.5})
    with pytest.raises(Exception, match="without a class"):
        portfolio.class_equal_weight(a, cls.where("asset != 'B'")).collect()
    base = spark.createDataFrame([("k", "A", 0.6), ("k", "B", 0.4)], "m string, asset string, weight double")
    aug = spark.createDataFrame([("k", "A", 0.2), ("k", "A2", 0.4), ("k", "B", 0.4)], "m string, asset string, weight double")
    assert portfolio.allocation_diagnostics(base, aug, ["m"]).first().l1 == pytest.approx(0.8)
    assert portfolio.allocation_diagnostics(base, portfolio.fold_clone(aug, "A2", "A", ["m"]), ["m"]).first().l1 == pytest.approx(0.0)


def test_solver_cases():
    assert kernels.minimum_variance(np.diag([0.04, 0.01]), 1.0) == pytest.approx([0.2, 0.8], abs=2e-5)
    w, state = kernels.robust(np.array([0.01, 0.20]), np.diag([0.01, 0.04]), 1.0, 0.15)
    assert state == "binding" and w.sum() == pytest.approx(1)
    with pytest.raises(kernels.Failed, match="below feasible minimum"):
        kernels.robust(np.zeros(2), np.diag([0.04, 0.04]), 1.0, 0.05)
    mu, c = np.array([0.12, 0.07, 0.03]), np.diag([0.04, 0.01, 0.0025])
    assert [kernels.attain(mu, c, 1.0, s)["status"] for s in (0.10, 0.01, 0.30)] == ["ATTAINED", "TARGET_NOT_ATTAINABLE", "TARGET_NOT_ATTAINABLE"]
    assert kernels.spectrum(np.eye(4))[0] == pytest.approx(4.0)


def test_solver_is_optimal_and_zero_radius_is_nominal():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.02, (120, 8))
    c, mu = np.cov(x.T) * 252, x.mean(0) * 252
    low = kernels.minimum_variance(c, 0.3)
    g = c @ low
    inside = (low > 1e-5) & (low < 0.3 - 1e-5)
    assert np.ptp(g[inside]) < 1e-6 and (g[low < 1e-6] >= g[inside].mean() - 1e-6).all()
    ceiling = 1.3 * np.sqrt(low @ c @ low)
    a, _ = kernels.robust(mu, c, 0.3, ceiling)
    b, _ = kernels.robust(mu, c, 0.3, ceiling, se=np.ones(8), rho=0.0, root=np.linalg.cholesky(c), rho_e=0.0)
    assert a == pytest.approx(b, abs=1e-6)
    for _ in range(300):  # no feasible portfolio earns more
        v = rng.dirichlet(np.ones(8))
        v = 0.5 * v + 0.5 * low
        if v.max() <= 0.3 and v @ c @ v <= ceiling**2:
            assert mu @ v <= mu @ a + 1e-6


def test_risk_parity_and_linkage():
    c = np.diag([0.04, 0.01])
    w = kernels.risk_parity(c, 1.0)
    assert w == pytest.approx([1 / 3, 2 / 3])
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert kernels.average_linkage(d, 0.2).tolist() == [0, 0, 1] and kernels.average_linkage(d, 0.86).tolist() == [0, 0, 0]


def mixed(seed: int, *counters: int) -> int:
    h = seed % 2**32
    for c in counters:
        h ^= c
        for factor in resampling.FACTORS:
            h = (h ^ (h >> 16)) * factor % 2**32
    return h


def test_numbers_are_even_and_do_not_repeat(spark):
    df = spark.range(20_000).withColumn("draw", F.col("id") % 10).withColumn("u", resampling.number(7, "draw", "id", F.lit(1)))
    rows = df.collect()
    assert all(r.u == mixed(7, r.draw, r.id, 1) for r in rows[::97])
    u = np.array([r.u for r in rows]) / 2**32
    assert len(set(u)) > 19_900 and abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.005
    assert np.histogram(u, 20, (0, 1))[0].min() > 880 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.03


def test_block_draws_go_on_from_their_starts(spark):
    keys = spark.createDataFrame([("a", 5), ("b", 6)], "key string, seed int")
    got = {(r.key, r.draw, r.position): r.source for r in resampling.block_draws(keys, 10, 4, 3).collect()}
    assert len(got) == 2 * 3 * 10
    for key, seed in (("a", 5), ("b", 6)):
        for d in range(3):
            assert [got[key, d, p] for p in range(10)] == [(mixed(seed, d, p // 4, resampling.BLOCK) + p % 4) % 10 for p in range(10)]


def test_paired_difference_is_constant(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0, 0.01, 60)
    rows = [(n, i, float(v + a)) for n, a in (("base", 0), ("up", 0.001)) for i, v in enumerate(r)]
    st = resampling.replicate_statistics(spark.createDataFrame(rows, "strategy string, pos int, ret double"), resampling.stationary_draws(spark, 60, 5, 40, 3), 1, 0.0)
    diff = st.groupBy("draw").agg((F.max("mean") - F.min("mean")).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert diff[0] == pytest.approx(0.001) and diff[1] == pytest.approx(0.001)


def test_uncertainty_is_reproducible(spark):
    x = np.random.default_rng(7).normal(0, 0.01, (80, 3))
    seeds = spark.createDataFrame([(D[700], 5)], "as_of date, seed int")
    run = lambda: resampling.uncertainty(windows(spark, x), seeds, 80, 252, 5, 40, 0.9, 21).first()
    a, b = run(), run()
    assert a == b and a.kappa >= 0 and a.box_rho > 0 and np.linalg.eigvalsh(np.array(a.mean_cov).reshape(3, 3))[0] > 0


def test_regimes_ignore_the_future(spark):
    n = 400
    rng = np.random.default_rng(1)
    p = panel(spark, {"M": rng.normal(0.001, 0.01, n)}).select("date", "ret")
    s = schedule(spark, [300])
    later = p.withColumn("ret", F.when(F.col("date") >= D[300], 0.5).otherwise(F.col("ret")))
    a, b = (regimes.classify(x, s, 252, 63, 252).collect() for x in (p, later))
    assert a == b and len(a) == 1


def test_normal_cdf_and_shape(spark):
    zs = [-8.5, -3.0, -1.0, 0.0, 0.5, 2.0, 6.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(stats.normal_cdf(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-max(min(z, 8), -8) / math.sqrt(2)) for z in zs], abs=1e-9)


def test_sources(spark, tmp_path):
    p = panel(spark, {"A": [0.1, 0.2], "B": [0.3, 0.4]})
    panels.write_wide_csv(p, str(tmp_path / "w"))
    assert sorted(map(tuple, panels.read_wide_csv(spark, str(tmp_path / "w")).select("date", "asset", "ret").collect())) == sorted(map(tuple, p.collect()))
    (tmp_path / "twice.csv").write_text("date,A\n2020-01-01,1\n2020-01-01,2\n")
    with pytest.raises(Exception, match="dates repeat"):
        panels.read_wide_csv(spark, str(tmp_path / "twice.csv")).collect()
    assert panels.canonical_json({"b": float("nan"), "a": [1]}) == '{"a":[1],"b":null}'
    assert sorted(r.json for r in panels.to_json_rows(spark.createDataFrame([("x", float("nan"))], "b string, a double")).collect()) == ['{"a":null,"b":"x"}']


def test_empty_panel(spark):
    p = spark.createDataFrame([], "date date, asset string, ret double")
    s = asof.quarter_schedule(p, 5)
    w = asof.training_windows(p, s, 5)
    assert s.count() == w.count() == estimators.cov_sample(w, 52).count() == kernels.minimum_variance_weights(kernels.repaired(estimators.cov_sample(w, 52)), 0.2).count() == 0


def test_a_bad_rate_fails_the_costs(spark):
    execs = spark.createDataFrame([("s", 1, "A", 0.6, 0.1), ("s", 1, "B", 0.4, 0.9)], "strategy string, as_of int, asset string, weight double, drifted double")
    rates = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "asset string, bps double")
    assert backtest.asset_costs(execs, rates).first().cost == pytest.approx(0.5 * 0.001 + 0.5 * 0.002)
    for bad in (rates.where("asset = 'A'"), rates.withColumn("bps", -rates.bps), rates.withColumn("bps", rates.bps * 1000)):
        with pytest.raises(Exception, match="cost rate of"):
            backtest.asset_costs(execs, bad).collect()
    with pytest.raises(ValueError):
        backtest.cost_model("square", 1.0)


def test_stationary_draws_position_by_position(spark):
    rows, expected, draws = 30, 5, 6
    got = {(r.draw, r.position): (r.source, r.run) for r in resampling.stationary_draws(spark, rows, expected, draws, 11).collect()}
    assert len(got) == rows * draws
    for d in range(draws):
        for p in range(rows):
            again = p == 0 or mixed(11, d, p, resampling.CHANCE) < 2**32 // expected
            want = (mixed(11, d, p, resampling.FRESH) % rows, p) if again else ((got[d, p - 1][0] + 1) % rows, got[d, p - 1][1])
            assert got[d, p] == want


def test_runs_have_the_expected_length_and_cover_all_rows(spark):
    one = resampling.stationary_draws(spark, 2000, 10, 50, 36129)
    r = one.agg(F.count("*").alias("n"), F.sum((F.col("run") == F.col("position")).cast("int")).alias("runs"), F.count_distinct("source").alias("sources")).first()
    assert r.n == 100_000 and 9.6 < r.n / r.runs < 10.4 and r.sources == 2000
    assert resampling.stationary_draws(spark, 1, 10, 3, 1).count() == 3


def test_normal_quantile_and_expected_maximum(spark):
    from statistics import NormalDist

    ps = [0.001, 0.3, 0.5, 0.8, 0.99, 1 - 1e-9]
    got = [r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").select(stats.normal_quantile(F.col("p")).alias("z")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-6)
    rows = spark.createDataFrame([(1,), (27,)], "n int").select(resampling.expected_max(F.col("n")).alias("m")).collect()
    g, inv = 0.5772156649015329, NormalDist().inv_cdf
    assert rows[0].m is None and rows[1].m == pytest.approx((1 - g) * inv(1 - 1 / 27) + g * inv(1 - 1 / (27 * math.e)))


def test_equal_rates_give_the_path_of_one_rate(spark):
    rng = np.random.default_rng(2)
    p = panel(spark, {a: rng.normal(0.001, 0.02, 30) for a in "ABC"})
    s = schedule(spark, [5, 15])
    books = spark.createDataFrame([("s", D[i], a, w) for i, ws in ((5, (0.2, 0.3, 0.5)), (15, (0.6, 0.3, 0.1))) for a, w in zip("ABC", ws, strict=True)], "strategy string, as_of date, asset string, weight double")
    rates = spark.createDataFrame([(n, a, b) for n, bs in (("even", (25.0,) * 3), ("own", (0.0, 10.0, 300.0))) for a, b in zip("ABC", bs, strict=True)], "scenario string, asset string, bps double")
    own = backtest.asset_rate_wealth(books, p, s, rates).cache()
    one = backtest.wealth(books, p, s, spark.createDataFrame([(25.0,)], "cost_bps double"))
    a, b = ([(r.date, r.net_wealth) for r in x.orderBy("date").collect()] for x in (own.where("scenario = 'even'"), one))
    assert len(a) == len(b) and [x[0] for x in a] == [x[0] for x in b] and [x[1] for x in a] == pytest.approx([x[1] for x in b], abs=1e-14)
    first = own.where("scenario = 'own'").orderBy("date").first()
    phi = 1 - first.transaction_cost
    assert phi + phi * (0.3 * 0.001 + 0.5 * 0.03) == pytest.approx(1)
    with pytest.raises(Exception, match="cost rate of C"):
        backtest.asset_rate_wealth(books, p, s, rates.where("asset != 'C'")).collect()
