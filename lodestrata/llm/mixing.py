"""Mixing sources to target weights by balanced sampling with the cube method.

Sources in code point order, null last, weigh 5, 2, 1 and again; together they take
SHARE of all words, a source at most CAP times its size, and what is above is shared
out anew by weight. A document of a source is due target / source_size copies: the
whole part for certain, the fraction as an inclusion probability. The flight phase
moves the fractions of three documents at a time along the null space of the two
balancing constraints (documents, words) until one is 0 or 1, so both totals stay.
It runs in blocks of a source; the two or fewer left open by each block form the next
round's blocks. A large document moves little in a flight and can stay open to its end, so
some hundred documents of at most a source's median size wait for its last block. There the
open ones are landed in the way that misses the fewest words, and what is still missed is
made up by turning documents over whose size comes closest to it, words before documents: a
source with documents of many sizes meets its target to within its smallest ones.

A source of any size is dealt over blocks by a hash of the id, the size and a number among
rows equal in both, so that no id, null or repeated, is a block of its own, and reruns agree
whatever the partitions. Every random number is drawn from the source, round and block.

Cases: null and empty texts have size 0 and are mixed like any other; null sources form
one source; repeated rows are mixed one by one (equal rows may differ in ``taken``);
null doc_ids are allowed; an empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD_PATTERN, bounded_batches, fresh, written

#: Fixed values of the contract.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0

#: Documents of a flight block; of those that wait for a source's last block.
BLOCK, WAITING = 2048, 256
#: Equal rows that one row stands for until they are told apart.
ALIKE = 4096
SEED = 9
EPS = 1e-9


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """Per source: source_size, docs, target. One row a source: the order over sources
    is a window over this aggregate, never over documents."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1)).withColumn("cap", CAP * F.col("source_size"))
    # water level: sources in the order in which they fill up
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level).withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    first = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    return levelled.withColumn("level", first).select("source", "source_size", "docs", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move p to 0 or 1 keeping sum(p) and sum(p * size); two at most stay open, none if land."""
    start = p.astype(float)
    p = start.tolist()
    x = size.astype(float).tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())

    def move(units: list[int], u: list[float]) -> None:
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(units, u) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(units, u) if d)
        step = up if next(draws) * (up + down) < down else -down
        for i, d in zip(units, u):
            v = p[i] + step * d
            p[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v

    held: list[int] = []
    for i in (i for i, v in enumerate(p) if EPS < v < 1 - EPS):
        held.append(i)
        if len(held) == 3:
            a, b, c = (x[j] for j in held)
            u = [c - b, a - c, b - a]
            move(held, u if any(u) else [1.0, -1.0, 0.0])
            held = [j for j in held if EPS < p[j] < 1 - EPS]
    out = np.array([round(v) if v < EPS or v > 1 - EPS else v for v in p])
    return landed(out, start, size, held) if land else out


def landed(p: np.ndarray, start: np.ndarray, size: np.ndarray, held: list[int]) -> np.ndarray:
    """Settle the documents held open so that the words miss those of start by the least, then
    turn over settled documents whose size comes nearest to the miss, while that lessens it."""
    p, want = p.copy(), float(start @ size)
    if held:
        fixed = float(np.delete(p, held) @ np.delete(size, held))
        p[held] = min(product((0.0, 1.0), repeat=len(held)), key=lambda way: abs(fixed + float(np.dot(way, size[held])) - want))
    free = np.flatnonzero((start > EPS) & (start < 1 - EPS) & (size > 0))
    free = free[np.argsort(size[free], kind="stable")]
    while True:
        miss = want - float(p @ size)
        fits = free[p[free] == (0.0 if miss > 0 else 1.0)]
        if not len(fits):
            return p
        at = int(np.searchsorted(size[fits], abs(miss)))
        best = min(fits[max(at - 1, 0) : at + 1], key=lambda i: abs(abs(miss) - size[i]))
        if abs(abs(miss) - size[best]) >= abs(miss):
            return p
        p[best] = 1.0 - p[best]


def _fly(key: tuple, rows: pa.Table) -> pa.Table:
    """One block of a source, as Arrow: ids and copies stay whole numbers beside nulls."""
    source, number, of, turn = (k.as_py() for k in key)
    rows = rows.sort_by([("size", "descending"), ("h", "ascending")])
    name = "" if source is None else f"s{source}"
    seed = zlib.crc32(f"{SEED}|{name}|{turn}|{number}".encode())
    p = flight(rows["p"].to_numpy(), rows["size"].to_numpy(), np.random.default_rng(seed), of == 1)
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def told_apart(sized: DataFrame) -> DataFrame:
    """The rows with h, a hash that tells rows apart which are equal in all columns."""
    alike = sized.groupBy(*sized.columns).agg(F.count("*").alias("n"))
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE).cast("long"))))
    each = parts.withColumn("number", F.explode(F.sequence("part", F.least(F.col("part") + ALIKE, F.col("n")) - 1)))
    return each.select(*sized.columns, F.xxhash64(*sized.columns, "number").alias("h"))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """Per row of docs: the kept columns, source, size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = {f"k{i}": c for i, c in enumerate(keep)}  # names of its own for the caller's columns
    sized = written(told_apart(docs.select(*[F.col(c).alias(k) for k, c in kept.items()], "source", word_count().alias("size"))))
    middle = sized.where("size > 0").groupBy("source").agg(F.percentile_approx("size", 0.5).alias("middle"))
    plan = written(targets(sized).join(middle.withColumnRenamed("source", "m"), F.col("source").eqNullSafe(F.col("m")), "left").drop("m"))
    due = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(CAP))).otherwise(0.0)
    whole = F.floor(due + EPS)
    joined = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    waits = (F.col("size") > 0) & (F.col("size") <= F.col("middle")) & (F.pmod(F.xxhash64("h", F.lit("wait")), F.col("docs")) < 2 * WAITING)
    current = joined.withColumns({"base": whole.cast("long"), "p": F.greatest(due - whole, F.lit(0.0)), "waits": F.coalesce(waits, F.lit(False))}).drop("middle")
    blocks = F.ceil(F.col("docs") / block)
    done, turn = None, 0
    while True:
        turns = (blocks == 1) | ~F.col("waits")
        part = F.pmod(F.xxhash64("h", F.lit(turn)), blocks).cast("long")
        open_rows = current.where(turns).withColumns({"turn": F.lit(turn), "of": blocks, "number": part})
        flown = written(open_rows.groupBy("source", "number", "of", "turn").applyInArrow(_fly, open_rows.schema)).drop("turn", "of", "number")
        settled = flown.where((F.col("p") == 0) | (F.col("p") == 1))
        done = settled if done is None else done.unionByName(settled)
        current = current.where(~turns).unionByName(flown.where((F.col("p") > 0) & (F.col("p") < 1)))
        turn += 1
        if current.isEmpty():
            break
        blocks = F.ceil(blocks * 2 / block)
    copies = (F.col("base") + F.col("p")).cast("long")
    names = [F.col(k).alias(c) for k, c in kept.items()] + [F.col("source")] * ("source" not in keep)
    return done.select(*names, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The mixed documents: the columns of docs and ``copies``, how often each is taken
    (1 or more). Rows equal in doc_id, text and source become one with the sum of their
    copies; a column of docs named copies gives way to the new one."""
    k, j, n = fresh(docs, "_k", "_j", "_copies")
    keyed = docs.withColumns({k: F.xxhash64("doc_id", "text", "source"), j: F.hash("text", "source", "doc_id")})
    plan = mix(keyed, keep=(k, j)).groupBy(k, j).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    taken = keyed.join(plan, [k, j]).dropDuplicates([k, j])
    return taken.select(*[c for c in docs.columns if c.lower() != "copies"], F.col(n).alias("copies"))
