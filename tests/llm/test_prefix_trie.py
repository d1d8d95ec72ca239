import hashlib
import random
import zlib
from collections import Counter, defaultdict

from lodestrata.llm import prefix_trie

TURNS = "conv_id long, turn int, role string, text string, d long, id string"


def brute(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        path = tuple(turns.get(base, [])[:h] + t[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = Counter(q[:-1] for q in members if q)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], sum(kids[q] == 0 for q in below), saved, digest))
    return sorted(out, key=lambda r: (r[1], r[0]))


def got(df) -> list[tuple]:
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {f.dataType.simpleString() for f in df.select(columns[:-1]).schema} == {"bigint"}
    return sorted([tuple(r) for r in df.select(columns).collect()], key=lambda r: (r[1], r[0]))


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(98, 112), 205, 1 << 40, -1, -100, -105]:
        texts = [rng.choice(["a", "bb", "", None, "çß中"]) for _ in range(rng.randint(1, 7))]
        rows += [(c, rng.choice([i, i, None]), rng.choice(["user", "user", None]), t) for i, t in enumerate(texts)]
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (None, 0, "user", "nobody")]
    rows += [(300, i, "user", f"long {i % 7}") for i in range(60)] + [(301, 0, "user", "x" * 50_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "extra") for r in rows], TURNS).repartition(3)
    assert got(prefix_trie.trie(df)) == brute(rows)


def test_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_ids_of_a_node_beyond_one_chunk(spark):
    ids = [1, 70_000, 200_001, 5_000_003]
    df = spark.createDataFrame([(i, 9, "user", "same", 0, "") for i in ids for _ in range(8)], TURNS)
    leaves = prefix_trie.trie(df).where("n_children = 0").collect()
    rows = [(i, 9, "user", "same") for i in ids for _ in range(8)]
    assert sorted(r.ends_sha256 for r in leaves) == sorted(r[-1] for r in brute(rows) if r[4] == 0)


def test_subtree_totals_of_chains_stars_and_forests(spark):
    rng = random.Random(8)
    parent = {0: None, 1000: None, 2000: None}
    parent |= {i: i - 1 for i in range(1, 150)}  # a chain
    parent |= {i: 1000 for i in range(1001, 1200)}  # a star
    parent |= {i: rng.choice([2000, *range(max(2000, i - 9), i)]) for i in range(2001, 2200)}
    value = {i: rng.randint(0, 9) for i in parent}
    want = dict.fromkeys(parent, 0)
    for i in parent:
        up = i
        while up is not None:
            want[up] += value[i]
            up = parent[up]
    df = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "id long, parent long, size long")
    rows = prefix_trie.subtree_totals(df, ["size"]).collect()
    assert len(rows) == len(parent) and {r.id: r["size"] for r in rows} == want
