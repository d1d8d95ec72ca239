"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two 64-bit fingerprints at 4 or fewer differing bits differ in at most 4 of their 8
bytes, so they share at least 4 positional bytes. The index lists each fingerprint
under sets of byte positions chosen so that any 4 shared positions contain one of the
sets (a Turan system: 7 pairs, or 20 triples where there are very many fingerprints).
For every two members of a list the shared positional bytes are tallied, pairs under 4
are dropped, the rest are verified by their differing bits. No link is lost.

Lists above a bound are dealt in blocks. Each block is compared within itself, and each
two blocks with each other, in one task each; a task reduces the links it verifies to a
spanning forest as it goes, holding at most PAIRS of them, never all pairs. Documents of
equal fingerprint count as one node, so copies are never expanded.

Cases: null, empty and white-space texts have fingerprint zero and link to each other
like any other; null doc_ids take part, but an id is the smallest only among non-null
ones (a component without any gets null); repeated rows return repeated rows; an empty
table returns no rows; very long texts are read whole; ties cannot arise, as links and
smallest ids do not depend on order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded_batches, fresh, scan, texts, words, written

SHINGLE_WORDS = 4
MAX_BITS = 4
BYTES = 8
#: Members of an index list that one task compares.
BLOCK = 1024
#: Links that a task holds before it reduces them; rows that it compares at once.
PAIRS, ROWS = 1 << 20, 1 << 16
#: Parts in which the members of a component meet their smallest id.
PARTS = 16
#: A fingerprint of more than one in so many rows is frequent: there are fewer of these than that.
FREQUENT = 1000
#: From so many distinct fingerprints on, lists are keyed by three bytes, not two.
TRIPLES_FROM = 1 << 26


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 values (seed 42)."""
    found = words(text.lower())
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= k:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        view, digest = memoryview(line), xxhash.xxh64_intdigest
        hashes = np.array([digest(view[s:e], 42) for s, e in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row (doc_id, fp) per row of docs; fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array([fingerprint(t) for t in texts(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return scan(docs, run, f"doc_id {id_type}, fp long", "doc_id", "text")


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any four positions contain one of them."""
    groups = [range(0, 3), range(3, 6), range(6, 8)]
    if size == 2:
        return [c for g in groups for c in combinations(g, 2)]
    inside = [c for g in groups for c in combinations(g, 3)]
    across = [(*c, x) for i, g in enumerate(groups) for c in combinations(g, 2) for x in groups[(i + 1) % 3]]
    return [tuple(sorted(c)) for c in inside + across]


def _key(number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("long")
    for p in positions:
        key = key * 256 + F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(255)
    return key


class Forest:
    """Links between rows, reduced to (row, smallest row reached) when there are many."""

    def __init__(self) -> None:
        self.a, self.b, self.held = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.held += len(a)
            if self.held > PAIRS:
                a, b = self.reduced()
                self.a, self.b, self.held = [a], [b], len(a)

    def reduced(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        nodes, position = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = position[: len(a)], position[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        own = label != np.arange(len(nodes))
        return nodes[own], nodes[label[own]]


def _first_sets(sets: list[tuple[int, ...]]) -> np.ndarray:
    """Per mask of shared byte positions: the first set that it contains, or -1."""
    held = [[n for n, s in enumerate(sets) if all(mask >> p & 1 for p in s)] for mask in range(1 << BYTES)]
    return np.array([h[0] if h else -1 for h in held])


def _linked(x: np.ndarray, number: np.ndarray, first: np.ndarray, limit: int) -> np.ndarray:
    """Whether fingerprints that differ by x link, in the first list where they meet."""
    shared = np.zeros(x.shape, np.uint8)  # mask of equal positional bytes
    for p in range(BYTES):
        shared |= (((x >> np.uint64(8 * p)) & np.uint64(255)) == 0).astype(np.uint8) << p
    enough = np.bitwise_count(shared) >= BYTES - limit
    return enough & (np.bitwise_count(x) <= limit) & (x != 0) & (first[shared] == number)


def _forest(data: np.ndarray, sets: list[tuple[int, ...]], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in rows (key, low, high, own, fp), sorted by key, low, high, as (node,
    smallest row's node). Lists with low < high link their two blocks with each other only."""
    key, fp, own = data[:, 0], data[:, 4].view(np.uint64), data[:, 3]
    first, found = _first_sets(sets), Forest()
    number = key // 256 ** len(sets[0])
    start = np.concatenate(([0], np.flatnonzero((data[1:, :3] != data[:-1, :3]).any(axis=1)) + 1))
    length = np.diff(np.concatenate((start, [len(fp)])))
    left = np.repeat(start + length, length) - np.arange(len(fp))  # rows to the list's end
    step, at = 1, np.flatnonzero((left > 1) & (data[:, 1] == data[:, 2]))
    while len(at):
        good = _linked(fp[at] ^ fp[at + step], number[at], first, limit)
        found.add(at[good], at[good] + step)
        step += 1
        at = at[left[at] > step]
    for s, n in zip(start.tolist(), length.tolist()):
        if data[s, 1] < data[s, 2]:
            rows = np.arange(s, s + n)
            one, two = rows[own[rows] == data[s, 1]], rows[own[rows] == data[s, 2]]
            for part in np.array_split(one, max(1, len(one) * len(two) // PAIRS)):
                i, j = np.nonzero(_linked(fp[part][:, None] ^ fp[two][None, :], number[s], first, limit))
                found.add(part[i], two[j])
    a, b = found.reduced()
    return fp[a], fp[b]


def links(distinct: DataFrame, n: int, block: int = BLOCK, limit: int = MAX_BITS, triples_from: int = TRIPLES_FROM) -> DataFrame:
    """(a, b): links between distinct fingerprints fp that span the same components as
    all pairs at ``limit`` or fewer differing bits. n: how many rows distinct has."""
    sets = position_sets(2 if n < triples_from else 3)
    index = distinct.select("fp", F.explode(F.array(*[_key(i, s) for i, s in enumerate(sets)])).alias("key"))
    sizes = index.groupBy("key").count()
    long_lists = sizes.where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    several = sizes.where(F.col("count").between(2, block)).select("key", F.lit(1).alias("blocks"))
    dealt = index.join(long_lists.unionByName(several), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp")
    bounded_batches(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def emit(data: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(data, sets, limit)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "low", "high", "own", "fp")]))
            rows += len(held[-1])
            if rows < ROWS:
                continue
            data = np.concatenate(held)
            ends = np.flatnonzero((data[:-1, :3] != data[1:, :3]).any(axis=1)) + 1
            cut = ends[-1] if len(ends) else 0
            if cut:
                yield emit(data[:cut])
            held, rows = [data[cut:].copy()], len(data) - cut
        if rows:
            yield emit(np.concatenate(held))

    keys = ["key", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) by alternating large and small
    stars; root is the smallest node. Each round is written to the shared folder."""

    def star(pairs: DataFrame, keep_low: bool) -> DataFrame:
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = pairs.join(low, "a")
        if keep_low:  # pairs have b < a: every lower neighbour and a itself go to the lowest
            moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        else:  # pairs in both directions: every higher neighbour goes to the lowest
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.where("a != b").distinct()

    def directed(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()

    current, before = written(directed(edges)), None
    while before is None or current.count() != before.count() or not current.join(before, ["a", "b"], "left_anti").isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        current, before = written(star(directed(star(both, keep_low=False)), keep_low=True)), current
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def assign(docs: DataFrame, block: int = BLOCK, triples_from: int = TRIPLES_FROM) -> DataFrame:
    """(doc_id, fp, root, component_id) per row of docs."""
    prints = written(fingerprints(docs))
    return classes(prints, block, triples_from)


def classes(prints: DataFrame, block: int = BLOCK, triples_from: int = TRIPLES_FROM) -> DataFrame:
    """From rows with fp and doc_id (further columns are kept): root, component_id."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("copies")))
    roots = components(links(distinct, distinct.count(), block, triples_from=triples_from))
    # members of components of two or more; a root may have very many, so they meet their
    # smallest id in parts
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    placed = distinct.join(members, distinct.fp == members.node).select("fp", "low_id", "root", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).alias("part"))
    low = placed.groupBy("root", "part").agg(F.min("low_id").alias("low")).groupBy("root").agg(F.min("low").alias("component_id"))
    parts = low.withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(PARTS)])))
    named = placed.join(parts, ["root", "part"]).select("fp", "root", "component_id", F.lit(True).alias("member"))
    every = distinct.join(named, "fp", "left")
    every = written(every.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("member"), F.col("component_id")).otherwise(F.col("low_id")).alias("component_id"), "copies"))
    # rows of frequent fingerprints, fewer than FREQUENT of them, do not move
    rows = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    often = F.col("copies") * FREQUENT > rows
    frequent, others = every.where(often).drop("copies"), every.where(~often).drop("copies")
    met = prints.join(F.broadcast(frequent), "fp")
    moved = prints.join(F.broadcast(frequent.select("fp")), "fp", "left_anti").join(others, "fp")
    return met.unionByName(moved)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return assign(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one of the smallest (doc_id, text),
    null ids last; of wholly equal rows, one. Returns the columns of docs."""
    k, j = fresh(docs, "_k", "_j")
    keyed = docs.withColumns({k: F.xxhash64("doc_id", "text"), j: F.hash("text", "doc_id")})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array([fingerprint(t) for t in texts(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", k, j)), fp], names=["doc_id", "_k", "_j", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = written(scan(keyed, run, f"doc_id {id_type}, _k long, _j int, fp long", "doc_id", k, j, "text"))
    chosen = classes(prints).groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "_k", "_j")).alias("c"))
    chosen = chosen.select(F.col("c._k").alias(k), F.col("c._j").alias(j))
    return keyed.join(chosen, [k, j], "left_semi").dropDuplicates([k, j]).select(*docs.columns)
