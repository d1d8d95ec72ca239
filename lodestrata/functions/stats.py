"""Column expressions of the panel engine: growth, moments, decay, normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_life_decay(half_life: float) -> float:
    """Weight of a row against the next one."""
    return 2.0 ** (-1.0 / half_life)


def decayed(k: Column, last: int, half_life: float) -> Column:
    """Unnormalised weight of row k, 1 at the last row."""
    return F.pow(F.lit(half_life_decay(half_life)), F.lit(last) - k)


def growth(ret: str) -> Column:
    return F.product(1 + F.col(ret))


def cagr(ret: str, per_year: int) -> Column:
    return F.pow(growth(ret), F.lit(float(per_year)) / F.count(ret)) - 1


def annual_vol(ret: str, per_year: int) -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(float(per_year)))


def skewness_unbiased(c: str) -> Column:
    n = F.count(c)
    return F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2.0)


def kurtosis_unbiased(c: str) -> Column:
    """Not excess: 3 for a normal distribution."""
    n = F.count(c)
    return (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(c) + 6.0) + 3.0


def null_if_not_finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def normal_cdf(z: Column) -> Column:
    """Phi by the series z * phi(z) * sum z^(2k) / (1*3*..*(2k+1)), for |z| <= 8 (else 0 or 1)."""
    zz = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(160)),
        start,
        lambda acc, k: F.struct((acc["term"] * zz * zz / (2 * k + 1)).alias("term"), (acc["total"] + acc["term"] * zz * zz / (2 * k + 1)).alias("total")),
    )["total"]
    return 0.5 + zz * F.exp(-zz * zz / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * series


def normal_quantile(p: Column, steps: int = 60) -> Column:
    """The inverse of Phi for p from 1/2 to about 1 - 1e-12: Newton's steps from 0, which come
    up to the root from below as Phi is concave there. Symmetric below 1/2."""
    far = F.greatest(p, 1 - p)
    density = lambda z: F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    z = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda z, _: z - (normal_cdf(z) - far) / density(z))
    return F.when(p < 0.5, -z).otherwise(z)
