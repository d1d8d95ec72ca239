"""Conversation prefix trie with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; its members are the conversations that start
with it. A turn is the SHA-256 of its role and text, a prefix the exclusive or of its turns'
hashes with their depths (120 bits), so that prefixes are running sums that any split of a
conversation can continue. Texts go no further than their turn's hash, but for the one
sort that orders turns.

``subtree_totals`` sums values over every subtree of any forest. A round rakes all leaves
into their parents (sums by parent, combined before the shuffle) and takes nodes with one
child out of their chains where they outrank both neighbours; the child then hangs from the
grandparent and carries what it passed. Rounds grow with the logarithm of the nodes, for
stars and for chains alike. Going back over the rounds, every node taken out gets its
child's total and what it noted. All joins of a round are one to one.

Cases: null roles and texts are empty; a null turn comes first; turns of equal number go by
role, then by hash, and rows repeated in full are turns of their own; rows without a
conv_id belong to no conversation and make none; a conversation without turns is a member
of the root alone; no conversations, no nodes; very long conversations span the partitions
of the sort, and no task holds one; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import written

#: Of the contract: conversations share starts by blocks of ids, by up to so many turns.
SHARED_BY, SHARED_TURNS = 100, 5
#: Ids that meet in one string: those that agree but for so many low bits.
CHUNK_BITS = 16


def borrowed(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return F.crc32(conv.cast("string").cast("binary")) % (SHARED_TURNS + 1)


def _positions(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, part, at, digest, chars), and for each part of a conversation the turns
    before it. Parts are those of one range sort, so that a long conversation has many."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", "turn", "role", "digest", "row"]
    turns = written(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    parts = turns.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv, length), and their turns (conv, length, block, d,
    digest, chars): the block's first turns, then a conversation's own after as many."""
    turns, parts = _positions(conversations)
    convs = parts.groupBy("conv").agg(F.sum("n").alias("turns")).withColumns({"h": borrowed(F.col("conv")), "base": F.col("conv") - F.col("conv") % SHARED_BY})
    has = convs.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    convs = convs.join(has, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0)))
    placed = turns.join(parts.join(convs, "conv"), ["conv", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    own = placed.where("pos > h").select("conv", "length", F.col("part").alias("block"), (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "digest", "chars")
    starts = placed.where(f"conv % {SHARED_BY} = 0 AND pos <= {SHARED_TURNS}").select(F.col("conv").alias("base"), F.col("pos").alias("d"), "digest", "chars")
    heads = convs.select("conv", "base", "length", "taken").join(starts, "base").where("d <= taken").select("conv", "length", F.lit(-1).alias("block"), "d", "digest", "chars")
    return convs.select("conv", "length"), heads.unionByName(own)


def _prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, length, d, the prefix (k1, k2), its parent (p1, p2), chars of its last turn."""
    marked = turns.withColumn("mark", F.sha2(F.concat_ws(":", F.col("d").cast("string"), "digest"), 256))
    lane = lambda i: F.conv(F.substring("mark", 15 * i + 1, 15), 16, 10).cast("long")
    marked = marked.select("conv", "length", "block", "d", "chars", lane(0).alias("x1"), lane(1).alias("x2"))
    so_far = Window.partitionBy("conv", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0))
    sums = marked.groupBy("conv", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    sums = sums.select("conv", "block", xor("x1", earlier).alias("o1"), xor("x2", earlier).alias("o2"))
    keyed = marked.withColumns({"w1": xor("x1", so_far), "w2": xor("x2", so_far)}).join(sums, ["conv", "block"])
    k1, k2 = F.col("w1").bitwiseXOR(F.col("o1")), F.col("w2").bitwiseXOR(F.col("o2"))
    nodes = keyed.select("conv", "length", "d", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("x1")).alias("p1"), k2.bitwiseXOR(F.col("x2")).alias("p2"), "chars")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    return nodes.unionByName(convs.select("conv", "length", zero.alias("d"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("chars")))


def _digests(prefixes: DataFrame) -> DataFrame:
    """d, k1, k2, ends_sha256 of nodes that conversations end at. Ids are joined to strings
    by chunks of near ids; a node's strings run through one hash in order, a batch at a time."""
    ends = prefixes.where("d = length").groupBy("d", "k1", "k2", F.shiftright("conv", CHUNK_BITS).alias("chunk"))
    ends = ends.agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last, digest = ["d", "k1", "k2"], None, None
        for batch in batches:
            done = []
            for node, ids in zip(zip(*(batch.column(n).to_pylist() for n in names), strict=True), batch.column("ids").to_pylist(), strict=True):
                if node != last:
                    if last is not None:
                        done.append((*last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _rows(done)
        if last is not None:
            yield _rows([(*last, digest.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["d", "k1", "k2", "ends_sha256"])

    dealt = ends.repartition("d", "k1", "k2").sortWithinPartitions("d", "k1", "k2", "chunk")
    return dealt.mapInArrow(run, "d long, k1 long, k2 long, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """tree: id, parent (null of roots; long both) and long values. For every id, each
    value's sum over the subtree, top included."""
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    own = {f"a_{v}": F.col(v) for v in values} | {f"u_{v}": F.lit(0).cast("long") for v in values}
    state = ["id", "parent", "n", *own]
    live = written(tree.join(kids, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumns(own).select(*state))
    rounds = []
    while not live.where("parent IS NOT NULL").isEmpty():
        leaf = F.col("n") == 0
        raked = live.where("n = 0 AND parent IS NOT NULL").select("id", *[F.col(f"a_{v}").alias(v) for v in values])
        sums = [F.sum(F.when(leaf, F.col(f"a_{v}") + F.col(f"u_{v}"))).alias(f"i_{v}") for v in values]
        into = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count_if(leaf).alias("gone"), F.max(F.when(~leaf, F.col("id"))).alias("child"), *sums)
        rest = live.where("n > 0 OR parent IS NULL").join(into, "id", "left")
        rest = rest.withColumns({"n": F.col("n") - F.coalesce("gone", F.lit(0))} | {f"a_{v}": F.col(f"a_{v}") + F.coalesce(f"i_{v}", F.lit(0)) for v in values})
        rest = written(rest.select(*state, "child"))
        live, spliced = _compressed(rest, values, len(rounds))
        rounds.append((raked, spliced))
    totals = live.select("id", *[F.col(f"a_{v}").alias(v) for v in values])
    for raked, spliced in reversed(rounds):
        if spliced is not None:
            back = spliced.join(totals, "id").select(F.col("via").alias("id"), *[(F.col(v) + F.col(f"v_{v}")).alias(v) for v in values])
            totals = totals.unionByName(written(back))
        totals = totals.unionByName(raked)
    return totals


def _compressed(rest: DataFrame, values: list[str], number: int) -> tuple[DataFrame, DataFrame | None]:
    """What stays of a raked forest once nodes are taken out of its chains, and the nodes
    taken out, by their child (id): via, and v_ what they add to the child's total."""
    links = rest.where("n = 1 AND parent IS NOT NULL").withColumn("rank", F.struct(F.xxhash64("id", F.lit(number)), "id"))
    above = links.select(F.col("child").alias("id"), F.col("rank").alias("above"))
    below = links.select(F.col("id").alias("child"), F.col("rank").alias("below"))
    out = links.join(above, "id", "left").join(below, "child", "left").where("(above IS NULL OR rank > above) AND (below IS NULL OR rank > below)")
    leaves = out.select("id", F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("top"), *[F.lit(0).cast("long").alias(f"{p}_{v}") for v in values for p in ("va", "vu")])
    joins = out.select(F.col("child").alias("id"), F.col("id").alias("via"), F.col("parent").alias("top"), *[F.col(f"{p}_{v}").alias(f"v{p}_{v}") for v in values for p in ("a", "u")])
    told = rest.drop("child").join(leaves.unionByName(joins).withColumn("told", F.lit(True)), "id", "left").where("told IS NULL OR via IS NOT NULL")
    passed = {f"v_{v}": F.col(f"u_{v}") + F.col(f"va_{v}") for v in values}
    carried = {f"u_{v}": F.col(f"u_{v}") + F.coalesce(F.col(f"va_{v}") + F.col(f"vu_{v}"), F.lit(0)) for v in values}
    kept = told.withColumns(passed | carried | {"parent": F.coalesce("top", "parent")})
    kept = written(kept.select("id", "parent", "n", *[f"a_{v}" for v in values], *[f"u_{v}" for v in values], "via", *passed))
    spliced = kept.where("via IS NOT NULL").select("id", "via", *passed)
    return kept.drop("via", *passed), None if spliced.isEmpty() else spliced


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations' trie, as the contract of op12 has them."""
    prefixes = written(_prefixes(*rebuilt(conversations)))
    nodes = prefixes.groupBy("d", "k1", "k2").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()))
    tops = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(tops, ["d", "p1", "p2"], "left")
    kids = linked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    linked = linked.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    linked = written(linked.join(_digests(prefixes), ["d", "k1", "k2"], "left").withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}))
    totals = subtree_totals(linked.select("id", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    whole = linked.drop("n_leaves", "saved_tokens").join(totals, "id")
    return whole.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def crc32_sql(codes: str) -> str:
    """DuckDB's expression for the crc32 of a list of byte values. The table of half bytes
    follows from the polynomial."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    halves = f"flatten(list_transform({codes}, lambda b: [b & 15, b >> 4]))"
    return f"xor(list_reduce({halves}, lambda c, b: xor(c >> 4, {table}[(xor(c, b) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


_CODES = "list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"

SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
cv AS (SELECT c, c - c % {SHARED_BY} AS base, {crc32_sql(_CODES)} % {SHARED_TURNS + 1} AS h FROM (SELECT DISTINCT c FROM t)),
taken AS (SELECT cv.c, count(t.pos) AS taken FROM cv LEFT JOIN t ON t.c = cv.base AND t.pos <= cv.h GROUP BY cv.c),
r AS (
  SELECT cv.c, t.pos AS d, t.role, t.text FROM cv JOIN t ON t.c = cv.base AND t.pos <= cv.h
  UNION ALL SELECT cv.c, t.pos - cv.h + k.taken, t.role, t.text FROM cv JOIN taken k ON k.c = cv.c JOIN t ON t.c = cv.c AND t.pos > cv.h),
p AS (
  SELECT c, d, length(text) AS chars, list({{'role': role, 'text': text}}) OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, 0, [] FROM cv),
n AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM p GROUP BY d, path),
a AS (SELECT p.c, p.d, n.conv_id FROM p JOIN n ON n.d = p.d AND n.path = p.path),
e AS (SELECT conv_id, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest FROM (SELECT *, max(d) OVER (PARTITION BY c) AS len FROM a) WHERE d = len GROUP BY conv_id, d),
l AS (SELECT n.*, a.conv_id AS parent_conv_id FROM n LEFT JOIN a ON a.c = n.conv_id AND a.d = n.d - 1),
k AS (SELECT parent_conv_id, d - 1 AS d, count(*) AS kids FROM l WHERE d > 0 GROUP BY ALL),
s AS (
  SELECT a.conv_id, a.d, count(*) FILTER (k.kids IS NULL) AS n_leaves, sum((l.n_convs - 1) * l.chars) AS saved
  FROM l JOIN a ON a.c = l.conv_id AND a.d <= l.d LEFT JOIN k ON k.parent_conv_id = l.conv_id AND k.d = l.d GROUP BY 1, 2)
SELECT l.conv_id, CAST(l.d AS BIGINT) AS depth, l.parent_conv_id, l.n_convs, coalesce(k.kids, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM l JOIN s ON s.conv_id = l.conv_id AND s.d = l.d LEFT JOIN k ON k.parent_conv_id = l.conv_id AND k.d = l.d LEFT JOIN e ON e.conv_id = l.conv_id AND e.d = l.d
"""
