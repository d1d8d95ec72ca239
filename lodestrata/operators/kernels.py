"""Linear algebra and convex programs: numpy inside tasks, one row a decision or scenario.

Windows and matrices travel as one row with arrays in asset order, so a task gets what
it solves and nothing else. Failures are rows with a status, never another portfolio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(windows: DataFrame) -> DataFrame:
    """as_of, assets, x (row-major: k, then asset)."""
    order = F.array_sort(F.collect_list(F.struct("k", "asset", "ret")))
    return windows.groupBy("as_of").agg(order.alias("o"), F.array_sort(F.collect_set("asset")).alias("assets")).select("as_of", "assets", F.col("o.ret").alias("x"))


def pack_matrix(cov: DataFrame) -> DataFrame:
    """as_of, assets, c (row-major)."""
    order = F.array_sort(F.collect_list(F.struct("asset_i", "asset_j", "cov")))
    return cov.groupBy("as_of").agg(order.alias("o"), F.array_sort(F.collect_set("asset_i")).alias("assets")).select("as_of", "assets", F.col("o.cov").alias("c"))


def psd_floor(c: np.ndarray, floor_abs: float = 1e-10, floor_rel: float = 1e-8) -> tuple[np.ndarray, float]:
    """Lift eigenvalues under max(abs, rel * mean variance); returns matrix and lift."""
    c = (c + c.T) / 2
    floor = max(floor_abs, floor_rel * np.trace(c) / len(c))
    values, vectors = np.linalg.eigh(c)
    lift = max(0.0, floor - values[0])
    if not lift:
        return c, 0.0
    out = (vectors * np.maximum(values, floor)) @ vectors.T
    return (out + out.T) / 2, float(lift)


def spectrum(c: np.ndarray) -> tuple[float, float]:
    """Effective rank exp(entropy of the eigenvalue shares), condition number."""
    v = np.linalg.eigvalsh((c + c.T) / 2)
    p = np.clip(v, 0, None)
    p = p / p.sum()
    p = p[p > 0]
    return float(np.exp(-(p * np.log(p)).sum())), float(v[-1] / max(v[0], 1e-18))


class Failed(ValueError):
    pass


def _newton(w, grad_hess, slack, steps=60, tol=1e-11):
    """Centre on sum(w) = 1 with step halving that stays where ``slack`` is positive."""
    n = len(w)
    for _ in range(steps):
        f, g, h = grad_hess(w)
        k = np.zeros((n + 1, n + 1))
        k[:n, :n] = h
        k[:n, n] = k[n, :n] = 1
        d = np.linalg.solve(k + np.diag([1e-14] * n + [0]), np.append(-g, 0))[:n]
        gap = -g @ d
        if gap / 2 < tol:
            break
        t = 1.0
        while t > 1e-12 and (not slack(w + t * d) or grad_hess(w + t * d)[0] > f - 0.25 * t * gap):
            t /= 2
        if t <= 1e-12:
            break
        w = w + t * d
    return w


def solve(mu: np.ndarray, c: np.ndarray, cap: float, gamma: float = 0.0, ceiling: float | None = None, se: np.ndarray | None = None, rho: float = 0.0, root: np.ndarray | None = None, rho_e: float = 0.0, start: np.ndarray | None = None, tol: float = 1e-9) -> np.ndarray:
    """max mu'w - rho se'w - rho_e |root' w| - gamma/2 w'Cw with sum 1, 0 <= w <= cap and,
    if given, w'Cw <= ceiling^2, by a log barrier. Long-only makes the box's norm linear."""
    n = len(mu)
    if n * cap < 1 - 1e-12:
        raise Failed("cap times assets is under 1")
    if abs(n * cap - 1) <= 1e-12:
        return np.full(n, 1.0 / n)
    lin = mu - (rho * np.abs(se) if se is not None else 0.0)
    cone = root @ root.T if root is not None and rho_e else None
    scale = max(np.abs(lin).max(), gamma * np.abs(np.diag(c)).max(), rho_e * np.sqrt(np.diag(cone).max()) if cone is not None else 0.0, 1e-12)
    limit = None if ceiling is None else ceiling * ceiling
    inner = min(cap, 1.0)

    def inside(w):
        return w.min() > 0 and (inner - w).min() > 0 and (limit is None or limit - w @ c @ w > 0)

    w = np.full(n, 1.0 / n) if start is None else start
    if not inside(w):
        raise Failed("no interior start")
    m, t = 2 * n + (limit is not None), 1.0
    while True:
        def grad_hess(w, t=t):
            cw = c @ w
            f = -lin @ w + gamma / 2 * w @ cw
            g = -lin + gamma * cw
            h = gamma * c
            if cone is not None:
                q = cone @ w
                norm = np.sqrt(max(w @ q, 1e-30))
                f, g, h = f + rho_e * norm, g + rho_e * q / norm, h + rho_e * (cone / norm - np.outer(q, q) / norm**3)
            f, g, h = t / scale * f, t / scale * g, t / scale * h
            f = f - np.log(w).sum() - np.log(inner - w).sum()
            g = g - 1 / w + 1 / (inner - w)
            h = h + np.diag(1 / w**2 + 1 / (inner - w) ** 2)
            if limit is not None:
                room = limit - w @ cw
                f, g, h = f - np.log(room), g + 2 * cw / room, h + 2 * c / room + 4 * np.outer(cw, cw) / room**2
            return f, g, h

        w = _newton(w, grad_hess, inside)
        if m / t < tol:
            return w
        t *= 12


def minimum_variance(c: np.ndarray, cap: float) -> np.ndarray:
    scale = np.abs(np.diag(c)).max()
    return solve(np.zeros(len(c)), c / scale, cap, gamma=1.0)


def robust(mu, c, cap, ceiling, se=None, rho=0.0, root=None, rho_e=0.0, tol: float = 5e-7) -> tuple[np.ndarray, str]:
    """Risk-ceiling problem; first the minimum-variance bound, then the program."""
    low = minimum_variance(c, cap)
    vol = float(np.sqrt(low @ c @ low))
    if vol > ceiling + tol:
        raise Failed(f"risk ceiling {ceiling:.8f} is below feasible minimum {vol:.8f}")
    if ceiling - vol <= 10 * tol * max(1.0, ceiling):
        return low, "binding"
    w = solve(mu, c, cap, ceiling=ceiling, se=se, rho=rho, root=root, rho_e=rho_e, start=low)
    return w, "binding" if abs(np.sqrt(w @ c @ w) - ceiling) <= 2e-4 * ceiling else "slack"


def clean(w: np.ndarray, cap: float) -> np.ndarray:
    """Clip to [0, cap]; the residual goes to the largest weight with room."""
    w = np.clip(np.where(np.abs(w) < 1e-9, 0.0, w), 0, cap)
    gap = 1 - w.sum()
    room = (cap - w >= gap) & (w + gap >= 0)
    i = np.flatnonzero(room)[np.argmax(w[room])] if room.any() else int(np.argmax(w))
    w[i] += gap
    return w


def attain(mu, c, cap, target, se=None, rho=0.0, root=None, rho_e=0.0, tol=2e-4, farthest=18.5, stride=2.75, steps=40) -> dict:
    """Risk aversion at which the robust portfolio's volatility meets the target: the root of
    the gap between them in the aversion's logarithm, bracketed by strides from 0 and closed
    in on by false position, halving the weight of an end that stays (Illinois)."""
    tried: dict[float, tuple[float, np.ndarray]] = {}

    def gap(x: float) -> float:
        if x not in tried:
            w = solve(mu, c, cap, gamma=float(np.exp(x)), se=se, rho=rho, root=root, rho_e=rho_e)
            tried[x] = float(np.sqrt(max(w @ c @ w, 0.0))) - target, w
        return tried[x][0]

    gap(-np.inf)  # no aversion at all
    least = minimum_variance(c, cap)
    low, top = float(np.sqrt(least @ c @ least)), tried[-np.inf][0] + target
    reason = "below the minimum variance bound" if target < low - tol else "above the volatility without risk aversion" if target > top + tol else None
    if reason is None and abs(top - target) > tol:
        a = b = 0.0
        way = 1.0 if gap(0.0) > 0 else -1.0
        while abs(b) < farthest and gap(b) * way > 0:
            a, b = b, b + way * stride
        fa, fb = gap(a), gap(b)
        while fa * fb < 0 and len(tried) < steps and min(abs(g) for g, _ in tried.values()) > tol / 10:
            x = (a * fb - b * fa) / (fb - fa)
            f = gap(x)
            if f * fb < 0:
                a, fa = b, fb
            else:
                fa /= 2
            b, fb = x, f
    x, (miss, w) = min(tried.items(), key=lambda t: abs(t[1][0]))
    if reason is None and abs(miss) > tol:
        reason = "the search ended"
    found = {"status": "ATTAINED", "w": w, "gamma": float(np.exp(x))} if reason is None else {"status": "TARGET_NOT_ATTAINABLE", "w": None, "gamma": 0.0}
    return found | {"reason": reason, "lower": low, "upper": top, "iterations": len(tried) - 1}


def risk_parity(c: np.ndarray, cap: float, rounds: int = 500) -> np.ndarray:
    """Equal risk contributions by coordinate descent on the log barrier; a binding cap
    fixes those assets at it and equalises the others' contributions."""
    n = len(c)
    fixed = np.zeros(n, bool)
    while True:
        w = np.where(fixed, cap, 0.0)
        free = np.flatnonzero(~fixed)
        y = np.full(len(free), 1.0)
        for _ in range(rounds):
            before = y.copy()
            for a, i in enumerate(free):
                b = c[i, free] @ y - c[i, i] * y[a]
                y[a] = (-b + np.sqrt(b * b + 4 * c[i, i])) / (2 * c[i, i])
            if np.abs(y - before).max() < 1e-12 * y.max():
                break
        w[free] = y / y.sum() * (1 - cap * fixed.sum())
        above = (w > cap + 1e-12) & ~fixed
        if not above.any():
            return w
        fixed |= above


def average_linkage(d: np.ndarray, cutoff: float) -> np.ndarray:
    """Clusters of average linkage cut at a distance, numbered by their smallest member."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(n), [[i] for i in range(n)]
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        at = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = np.unravel_index(np.argmin(at), at.shape)
        if at[i, j] > cutoff:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        size[i] += size[j]
        member[i] += member[j]
        alive[j] = False
    label = np.empty(n, int)
    for number, i in enumerate(sorted(np.flatnonzero(alive), key=lambda i: min(member[i]))):
        label[member[i]] = number
    return label


# Spark forms


def over_rows(df: DataFrame, function, schema: str) -> DataFrame:
    """function(row) -> list of tuples, for each row of df, spread over the cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for frame in batches:
            yield pd.DataFrame([t for r in frame.itertuples(index=False) for t in function(r)], columns=names)

    return df.mapInPandas(run, schema)


def repaired(cov: DataFrame, floor_abs: float = 1e-10, floor_rel: float = 1e-8) -> DataFrame:
    """as_of, assets, c with eigenvalues lifted, and the lift."""

    def one(r):
        n = len(r.assets)
        c, lift = psd_floor(np.array(r.c).reshape(n, n), floor_abs, floor_rel)
        return [(r.as_of, list(r.assets), c.ravel().tolist(), lift)]

    return over_rows(pack_matrix(cov), one, "as_of date, assets array<string>, c array<double>, ridge double")


def diagnostics(matrices: DataFrame) -> DataFrame:
    """as_of, effective_rank, condition, min_eigenvalue."""

    def one(r):
        c = np.array(r.c).reshape(len(r.assets), -1)
        rank, condition = spectrum(c)
        return [(r.as_of, rank, condition, float(np.linalg.eigvalsh(c)[0]))]

    return over_rows(matrices, one, "as_of date, effective_rank double, condition double, min_eigenvalue double")


def gaussian_loss(matrices: DataFrame, evaluation: DataFrame, per_year: int) -> DataFrame:
    """Mean Gaussian negative log-likelihood per asset of the rows after each forecast.
    evaluation: as_of, k, asset, ret."""
    joined = matrices.join(pack(evaluation).select("as_of", "x"), "as_of")

    def one(r):
        n = len(r.assets)
        chol = np.linalg.cholesky(np.array(r.c).reshape(n, n) / per_year)
        z = np.linalg.solve(chol, np.array(r.x).reshape(-1, n).T)
        return [(r.as_of, float((2 * np.log(np.diag(chol)).sum() + (z * z).sum(0).mean()) / n))]

    return over_rows(joined, one, "as_of date, nll double")


def minimum_variance_weights(matrices: DataFrame, cap: float) -> DataFrame:
    """as_of, asset, weight, status, predicted_vol."""

    def one(r):
        c = np.array(r.c).reshape(len(r.assets), -1)
        try:
            w = clean(minimum_variance(c, cap), cap)
        except (Failed, np.linalg.LinAlgError) as e:
            return [(r.as_of, None, None, f"FAILED: {e}", None)]
        return [(r.as_of, a, float(v), "OPTIMAL", float(np.sqrt(w @ c @ w))) for a, v in zip(r.assets, w)]

    return over_rows(matrices, one, "as_of date, asset string, weight double, status string, predicted_vol double")


def risk_parity_weights(matrices: DataFrame, cap: float) -> DataFrame:
    def one(r):
        w = risk_parity(np.array(r.c).reshape(len(r.assets), -1), cap)
        return [(r.as_of, a, float(v)) for a, v in zip(r.assets, w)]

    return over_rows(matrices, one, "as_of date, asset string, weight double")


MODELS = ["nominal", "box", "box_diagonal", "ellipsoid"]


def model_inputs(model: str, c: np.ndarray, se: np.ndarray, mean_cov: np.ndarray, box_rho: float, ellipsoid_rho: float, kappa: float) -> dict:
    """The program's terms of each robust model."""
    if model == "nominal":
        return {"c": c}
    if model == "ellipsoid":
        return {"c": c, "root": np.linalg.cholesky(mean_cov), "rho_e": ellipsoid_rho}
    inflated = c + kappa * np.diag(np.diag(c)) if model == "box_diagonal" else c
    return {"c": inflated, "se": se, "rho": box_rho}


def model_terms(scenarios: DataFrame) -> DataFrame:
    """as_of, model, uses_box, uses_diagonal, uses_ellipsoid: what each model's program takes
    in, read off its terms for every stored scenario. A term of no size is none."""

    def one(r):
        n = len(r.assets)
        base = np.array(r.c).reshape(n, n)
        terms = model_inputs(r.model, base, np.array(r.se), np.array(r.mean_cov).reshape(n, n), r.box_rho, r.ellipsoid_rho, r.kappa)
        box = bool(terms.get("rho", 0.0) > 0 and np.any(terms["se"] > 0))
        return [(r.as_of, r.model, box, not np.array_equal(terms["c"], base), bool(terms.get("rho_e", 0.0) > 0 and np.any(terms["root"])))]

    return over_rows(scenarios, one, "as_of date, model string, uses_box boolean, uses_diagonal boolean, uses_ellipsoid boolean")


def robust_weights(scenarios: DataFrame) -> DataFrame:
    """scenarios: as_of, scenario, model, multiple (of the minimum volatility), cap, assets,
    c, mu, se, mean_cov, box_rho, ellipsoid_rho, kappa. A row an asset, or one with the
    failure. base_vol is against the matrix without the model's inflation."""

    def one(r):
        n = len(r.assets)
        base = np.array(r.c).reshape(n, n)
        terms = model_inputs(r.model, base, np.array(r.se), np.array(r.mean_cov).reshape(n, n), r.box_rho, r.ellipsoid_rho, r.kappa)
        low = minimum_variance(base, r.cap)
        ceiling = r.multiple * float(np.sqrt(low @ base @ low))
        try:
            w, state = robust(np.array(r.mu), terms.pop("c"), r.cap, ceiling, **terms)
            w = clean(w, r.cap)
        except (Failed, np.linalg.LinAlgError) as e:
            return [(r.as_of, r.scenario, r.model, ceiling, None, None, None, "FAILED", str(e))]
        vol = float(np.sqrt(w @ base @ w))
        return [(r.as_of, r.scenario, r.model, ceiling, a, float(v), vol, "OPTIMAL", state) for a, v in zip(r.assets, w)]

    return over_rows(scenarios, one, "as_of date, scenario string, model string, ceiling double, asset string, weight double, base_vol double, status string, message string")


def attainment(scenarios: DataFrame) -> DataFrame:
    """The same input; the search for a risk aversion that meets multiple x minimum."""

    def one(r):
        n = len(r.assets)
        base = np.array(r.c).reshape(n, n)
        terms = model_inputs(r.model, base, np.array(r.se), np.array(r.mean_cov).reshape(n, n), r.box_rho, r.ellipsoid_rho, r.kappa)
        low = minimum_variance(base, r.cap)
        scale = float(np.sqrt(low @ base @ low))
        found = attain(np.array(r.mu), terms.pop("c"), r.cap, r.multiple * scale, tol=2e-3 * scale, **terms)
        return [(r.as_of, r.scenario, r.model, r.multiple * scale, found["status"], found["reason"], found["lower"], found["upper"], int(found["iterations"]), float(found["gamma"]))]

    return over_rows(scenarios, one, "as_of date, scenario string, model string, target double, status string, reason string, lower double, upper double, iterations int, gamma double")


def clusters(distances: DataFrame, thresholds: list[float]) -> DataFrame:
    """as_of, threshold, asset, cluster: average linkage of correlation distances
    (as_of, asset_i, asset_j, distance), cut where the correlation is the threshold."""
    packed = pack_matrix(distances.withColumnRenamed("distance", "cov"))

    def one(r):
        d = np.array(r.c).reshape(len(r.assets), -1)
        return [(r.as_of, t, a, int(k)) for t in thresholds for a, k in zip(r.assets, average_linkage(d, np.sqrt((1 - t) / 2)))]

    return over_rows(packed, one, "as_of date, threshold double, asset string, cluster int")


def eigen_shock(matrices: DataFrame, factor: float = 1.10) -> DataFrame:
    """The largest eigenvalue multiplied, repaired again."""

    def one(r):
        n = len(r.assets)
        values, vectors = np.linalg.eigh(np.array(r.c).reshape(n, n))
        values[-1] *= factor
        c, _ = psd_floor((vectors * values) @ vectors.T)
        return [(r.as_of, list(r.assets), c.ravel().tolist())]

    return over_rows(matrices, one, "as_of date, assets array<string>, c array<double>")
