"""Sums over pairs of series as products of blocks.

Series are dealt into blocks by hash, and long ones are cut at every CHUNK places. A block
of packed series goes once to every block it is paired with, and a task multiplies one pair
of blocks: what is shuffled grows with the series times the blocks, not with the pairs at
every place. Two series meet where both have a value, so each product has its counts.

Cases: a missing row or a null is no value; a series has one value a place; places are
whole numbers; no rows, no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Series of a block, places of a chunk: a pair of blocks takes about 2 x 2 MB in a task.
BLOCK, CHUNK = 128, 1024

KEYS = ["as_of", "asset_i", "asset_j"]
SUMS = ["n", "w", "x", "y", "xy", "xx", "yy"]


def _packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values and where there are any, places by series."""
    places, values = (table.column(c).combine_chunks() for c in ("places", "values"))
    series = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
    x, m = np.zeros((CHUNK, len(places))), np.zeros((CHUNK, len(places)))
    at = places.flatten().to_numpy()
    x[at, series], m[at, series] = values.flatten().to_numpy(), 1.0
    return x, m


def cells(rows: DataFrame, value: str = "ret", decay: tuple[float, int] | None = None, places: int | None = None, block: int = BLOCK) -> DataFrame:
    """rows: as_of, k, asset and the value. For asset_i <= asset_j over the places that both
    have: n how many, w their weights, and weighted sums of x, y, xy, xx, yy. decay: b and
    last of weights b^(last - k). places: how many k there are from 0 on, if that is known
    to be at most CHUNK, nothing is left to add up."""
    part = F.floor(F.col("k") / CHUNK)
    series = rows.where(F.col(value).isNotNull()).select("as_of", "asset", part.alias("part"), (F.col("k") - part * CHUNK).cast("int").alias("place"), F.col(value).cast("double").alias("v"))
    series = series.groupBy("as_of", "part", "asset").agg(F.collect_list(F.struct("place", "v")).alias("s")).select("as_of", "part", "asset", F.col("s.place").alias("places"), F.col("s.v").alias("values"))
    blocks = max(1, -(-rows.select("asset").distinct().count() // block))
    own = F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int")
    dealt = series.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}).drop("other")

    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        part, left, right = (k.as_py() for k in key[1:])
        side = np.asarray(table.column("own"))
        names = np.array(table.column("asset").to_pylist(), dtype=object)
        x, m = _packed(table)
        w = np.ones(CHUNK) if decay is None else decay[0] ** (decay[1] - (part * CHUNK + np.arange(CHUNK)))
        a, b = np.flatnonzero(side == left), np.flatnonzero(side == right)
        times = lambda p, q: (p[:, a] * w[:, None]).T @ q[:, b]
        out = {"n": m[:, a].T @ m[:, b], "w": times(m, m), "x": times(x, m), "y": times(m, x), "xy": times(x, x), "xx": times(x * x, m), "yy": times(m, x * x)}
        i, j = np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij")
        met = out["n"] > 0
        if left == right:
            met &= names[a][i] <= names[b][j]
        i, j = i[met], j[met]
        first, second = names[a][i], names[b][j]
        turned = first > second
        flat = {k: v[met] for k, v in out.items()}
        for p, q in (("x", "y"), ("xx", "yy")):
            flat[p], flat[q] = np.where(turned, flat[q], flat[p]), np.where(turned, flat[p], flat[q])
        columns = [pa.repeat(key[0], len(i)), pa.array(np.where(turned, second, first), pa.string()), pa.array(np.where(turned, first, second), pa.string())]
        return pa.table([*columns, *[pa.array(flat[k], pa.float64()) for k in SUMS]], names=[*KEYS, *SUMS])

    kind = rows.schema["as_of"].dataType.simpleString()
    found = dealt.groupBy("as_of", "part", "left", "right").applyInArrow(multiply, f"as_of {kind}, asset_i string, asset_j string, " + ", ".join(f"{s} double" for s in SUMS))
    if places is not None and places <= CHUNK:
        return found
    return found.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])


def mirrored(found: DataFrame) -> DataFrame:
    """Cells of asset_i <= asset_j in both orders."""
    own = F.struct("asset_i", "asset_j")
    other = F.struct(F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"))
    orders = F.when(F.col("asset_i") == F.col("asset_j"), F.array(own)).otherwise(F.array(own, other))
    rest = [c for c in found.columns if c not in KEYS]
    return found.select("as_of", F.explode(orders).alias("pair"), *rest).select("as_of", "pair.asset_i", "pair.asset_j", *rest)


def covariance():
    """Sample covariance of a cell of unweighted sums, null of fewer than two places."""
    return (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0.0))


def pearson():
    """Correlation of a cell, within [-1, 1]; null where a series does not vary there."""
    spread = lambda s, q: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    vx, vy = spread("x", "xx"), spread("y", "yy")
    varies = (vx > 1e-14 * F.col("xx")) & (vy > 1e-14 * F.col("yy"))
    rho = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(vx * vy)
    return F.when(varies, F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0)))
