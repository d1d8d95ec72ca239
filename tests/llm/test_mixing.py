import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing as M


def brute_targets(sizes):
    """sizes: source -> words. The rule of the contract, step by step."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, capped = 1.5 * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        w = sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        above = {s for s in free if target[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def rows(n=900, seed=1):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c", "d", None]
    return [(i, " ".join(["w"] * int(rng.integers(0, 60))), names[0] if i % 3 else names[int(rng.integers(0, 5))]) for i in range(n)]


def test_targets_totals_and_reruns(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").repartition(5)
    got = M.mix(docs, block=64).collect()
    sizes = {}
    for _, t, s in rows():
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = M.mix(docs.repartition(3), block=64).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    p, x = np.full(500, 0.37), rng.integers(1, 1000, 500)
    out = M.flight(p, x, np.random.default_rng(1), land=False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * x).sum() - (p * x).sum()) < 1e-4
    assert set(np.unique(M.flight(out, x, np.random.default_rng(2), land=True))) <= {0.0, 1.0}


def test_inclusion_is_unbiased():
    x = np.arange(1, 41)
    mean = np.mean([M.flight(np.full(40, 0.3), x, np.random.default_rng(i), land=False) for i in range(1500)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.06


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_source_meets_its_target_within_its_median_document(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    for block in (M.BLOCK, 128):
        by = M.mix(docs, block=block).groupBy("source").agg(F.abs(F.sum("taken") - F.first("target")).alias("miss"), F.median("size").alias("median"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
        rows = by.collect()
        assert len(rows) >= 10 and all(r.over <= 0 and r.miss <= max(r.median, 1) for r in rows), [r for r in rows if r.miss > r.median]


def test_ids_that_are_null_or_repeat_are_dealt_over_all_blocks(spark):
    rows = spark.range(40_000).select(F.lit(None).cast("long").alias("k0"), F.lit("a").alias("source"), (F.col("id") % 7).alias("size"))
    apart = M.told_apart(rows)
    sizes = apart.groupBy(F.pmod(F.xxhash64("h", F.lit(0)), F.lit(20))).count().collect()
    assert apart.count() == 40_000 and len(sizes) == 20 and max(r["count"] for r in sizes) < 2300
    docs = spark.range(6_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.lit(1).alias("h"), F.lit(2).alias("p"))
    got = M.mix(docs, keep=("doc_id", "h", "p"), block=256).agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.count("*").alias("n")).first()
    assert got.n == 6_000 and abs(got.t - got.w) <= 4


def test_odd_rows(spark, documents, empty):
    got = M.mix(documents)
    assert got.count() == documents.count()
    assert M.mix(empty).count() == 0
    zero = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r.taken for r in M.mix(zero).collect()} == {0}
    taken = M.take(documents)
    assert taken.columns == [*documents.columns, "copies"] and taken.where("copies < 1").count() == 0


def test_large_ids_stay_exact_beside_nulls(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big + i, "w " * (i + 1), None if i % 2 else "a") for i in range(40)] + [(None, "w w", "a")], "doc_id long, text string, source string")
    assert {r.doc_id for r in M.mix(docs).collect()} == {big + i for i in range(40)} | {None}
